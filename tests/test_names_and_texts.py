import difflib

import pytest
from pyspark.sql import functions as F

from placescope.functions import harvest, names
from placescope.operators import joins
from placescope.plans.signals import growth_table


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Jammu  &  Kashmir*", "JAMMU AND KASHMIR"),
        (" NCT of Delhi ", "DELHI"),
        ("Daman & Diu**", "DADRA AND NAGAR HAVELI AND DAMAN AND DIU"),
    ],
)
def test_region_names(spark, raw, want):
    assert one(spark, raw, names.norm_region) == want


@pytest.mark.parametrize(
    "raw, region, want",
    [
        ("South-West", "DELHI", "SOUTH WEST DELHI"),
        ("Shahdara", "DELHI", "SHAHDARA"),
        ("New Delhi", "DELHI", "NEW DELHI"),
        ("bengaluru urban district", "KARNATAKA", "BANGALORE URBAN"),
        ("Y.S.R.", "ANDHRA PRADESH", "YSR KADAPA"),
    ],
)
def test_group_names(spark, raw, region, want):
    assert one(spark, raw, lambda c: names.norm_group(c, F.lit(region))) == want


@pytest.mark.parametrize(
    "raw, kind, want",
    [
        ("Chakragaon S.O", "S.O", "Chakragaon"),
        ("Patel Nagar S.O (Central Delhi)", "S.O", "Patel Nagar"),
        ("Fort (West) B.O (Old)", "B.O", "Fort"),
        ("(Camp)", "S.O", "(Camp)"),
    ],
)
def test_office_names(spark, raw, kind, want):
    assert one(spark, raw, lambda c: names.clean_office(c, F.lit(kind))) == want


@pytest.mark.parametrize("raw, want", [("3,41,258", 341258.0), ("64,473[37]", 64473.0), ("-", None), ("", None)])
def test_numbers(spark, raw, want):
    assert one(spark, raw, names.parse_number) == want


def test_coercion_and_bands(spark):
    for raw in ("", "NaN", "inf", "-Infinity", "abc"):
        assert one(spark, raw, names.coerce_number) is None
    assert one(spark, " 12 ", names.coerce_number) == 12.0
    assert one(spark, "05-Oct", names.fix_band) == "5-10"
    assert one(spark, "40-50", names.fix_band) == "40-50"


def test_codes(spark):
    assert one(spark, 'Main Road, Pune 411001" ', names.trailing_code) == "411001"
    assert one(spark, "Pune 411001 West", names.trailing_code) is None
    assert one(spark, "110001 x 012345 1234567 110001", names.codes_in) == ["110001", "110001"]
    assert one(spark, "990001", names.region_of) == "XX"


def test_classes_are_ordered(spark):
    assert one(spark, "Ujjivan Gramin Bank", names.classify) == "sfb"
    assert one(spark, "Kaveri GRAMEENA cooperative bank", names.classify) == "rrb"
    assert one(spark, "State Bank", names.classify) == ""


def test_land_record_units_and_band(spark):
    texts = [
        "Rate per sq.ft: Rs. 4,500 Total area: 10 sq ft Sale value: Rs 1",
        "Market value: INR 1,45,00,000 Plot area: 1,200 sq.ft",
        "Total consideration: ₹ 100 Land area: 5 acre",
        "nothing here",
    ]
    rows = harvest.land_record(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [r["confidence"] for r in rows] == ["high", "medium", "low", "low"]
    assert rows[0]["rate_per_sqft"] == 4500.0 and rows[1]["rate_per_sqft"] == 12083.0


def test_vehicle_record(spark):
    text = "Fuel Type: PETROL/CNG\nVehicle class - M/CYCLE\nOwner A\nAddress: x 560001\nInvoice value: Rs. 21,00,000"
    r = harvest.vehicle_record(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r["fuel_type"], r["vehicle_class"], r["owner_code"]) == ("Petrol/cng", "M/CYCLE", "560001")
    assert r["price"] == 2100000.0 and r["is_luxury"]


def test_region_rows_last_line_wins(spark):
    text = "Delhi | 1.5 | 100\nUttar Pradesh  200  3,000\nDelhi | 2.5 | 3,41,258\n"
    rows = harvest.region_rows(spark.createDataFrame([(1, text)], "doc int, t string"), "t", ["doc"]).collect()
    assert {(r["region"], r["volume"], r["amount"]) for r in rows} == {("delhi", 2.5, 341258.0), ("uttar pradesh", 200.0, 3000.0)}


def test_fuzzy_candidates_are_complete(spark):
    words = ["jamkhandi", "jamakhandi", "mudhola", "mudhol", "bangalorenorth", "bangaloresouth", "hospet", "a", "ab",
             "shimogataluk", "shimogatalukx", "xshimogataluk", "belagavi", "belgavi", "chikkaballapur", "chikballapur"]
    left = spark.createDataFrame([(w,) for w in words], "left_name string")
    right = spark.createDataFrame([(w,) for w in words], "right_name string")
    for cutoff in (0.9, 0.8):
        got = {(r["left_name"], r["right_name"]) for r in joins.fuzzy_candidates(left, right, cutoff).collect()}
        want = {(a, b) for a in words for b in words if difflib.SequenceMatcher(None, b, a).ratio() >= cutoff}
        assert got == want


def test_matching_uses_each_name_once(spark):
    left = spark.createDataFrame([("shivamogga",), ("mudhola",), ("mudhol",), ("zzz",)], "left_name string")
    right = spark.createDataFrame([("shimoga",), ("mudhol",), ("other",)], "right_name string")
    got = {r["left_name"]: (r["right_name"], r["tier"]) for r in joins.match_names(left, right).collect()}
    assert got == {"shivamogga": ("shimoga", "alias"), "mudhol": ("mudhol", "exact")}


# Published vehicle counts per region: base, latest, growth in percent, calibration weight.
VEHICLES = """Andaman and Nicobar Islands,10095,20035,98.5,1.1042
Andhra Pradesh,1833440,3278063,78.8,1.0561
Arunachal Pradesh,18111,34745,91.8,1.0889
Assam,311833,601373,92.9,1.0913
Bihar,592083,1068508,80.5,1.0605
Chandigarh,595500,739028,24.1,0.8333
Chhattisgarh,526161,805916,53.2,0.9762
Dadra and Nagar Haveli,7885,19092,142.1,1.1883
Daman and Diu,6208,14134,127.7,1.1631
Goa,131140,185928,41.8,0.9302
Gujarat,3030412,5057790,66.9,1.0221
Haryana,1452749,2299806,58.3,0.9943
Himachal Pradesh,175525,276464,57.5,0.9916
Jammu and Kashmir,269309,494989,83.8,1.0692
Jharkhand,361391,561082,55.3,0.9837
Karnataka,3810509,6138570,61.1,1.0037
Kerala,1845703,2973515,61.1,1.0037
Lakshadweep,600,829,38.2,0.9135
Madhya Pradesh,1362127,2357157,73.0,1.0402
Maharashtra,17336693,25076009,44.6,0.9426
Manipur,17052,44830,162.9,1.2212
Meghalaya,39851,59756,49.9,0.964
Mizoram,16741,31755,89.7,1.0838
Nagaland,19694,36343,84.5,1.071
Delhi,8154989,11310430,38.7,0.916
Odisha,700047,1064682,52.1,0.9722
Puducherry,72595,108992,50.1,0.9648
Punjab,1745312,2193078,25.7,0.8438
Rajasthan,1728246,2675229,54.8,0.9821
Sikkim,12937,25556,97.5,1.1021
Tamil Nadu,6010881,8176334,36.0,0.9031
Telangana,3044645,4558852,49.7,0.9632
Tripura,42763,90363,111.3,1.1316
Uttar Pradesh,2543474,4040930,58.9,0.9963
Uttarakhand,261773,477089,82.3,1.0652
West Bengal,2926697,3682627,25.8,0.8449"""


def test_growth_weights_match_published_figures(spark):
    rows = [line.rsplit(",", 4) for line in VEHICLES.splitlines()]
    df = spark.createDataFrame([(r[0], float(r[1]), float(r[2])) for r in rows], "name string, base double, latest double")
    got = {r["name"]: (r["growth_pct"], r["weight"]) for r in growth_table(df).collect()}
    assert got == {r[0]: (float(r[3]), float(r[4])) for r in rows}


def test_keywords_inside_words_and_of_two_words(spark):
    texts = spark.createDataFrame([(1, "BengaluruUrban zone"), (2, "navi mumbai east"), (3, "mumbai"), (4, None), (5, "nothing")], "k int, t string")
    found = {r.k: r.word for r in joins.keyword_lookup(texts, "t", ["navi mumbai", "bengaluru", "mumbai"], "word").collect()}
    assert found == {1: "bengaluru", 2: "navi mumbai", 3: "mumbai", 4: None, 5: None}


def test_one_to_one_settles_a_long_chain_in_order(spark):
    chain = [(f"l{k:03}", f"r{k:03}", 0.9 + k / 10_000) for k in range(120)] + [(f"l{k:03}", f"r{k + 1:03}", 0.9 + k / 10_000 + 0.00005) for k in range(119)]
    got = {(r["left"], r["right"]) for r in joins.one_to_one(spark.createDataFrame(chain, "left string, right string, ratio double"), "left", "right").collect()}
    want, lefts, rights = set(), set(), set()
    for a, b, _ in sorted(chain, key=lambda p: (-p[2], p[0], p[1])):
        if a not in lefts and b not in rights:
            want.add((a, b))
            lefts.add(a)
            rights.add(b)
    assert got == want


def test_synthetic_keys_do_not_collide(spark):
    many = spark.range(100_000).select(names.synthetic_key(F.col("id").cast("string"), F.lit(1.5), F.lit(2.5)).alias("k"))
    assert many.distinct().count() == 100_000

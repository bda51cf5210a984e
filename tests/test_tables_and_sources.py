import json
import random

import pytest
from pyspark.sql import functions as F

from placescope.operators import rates, tables
from placescope.sources import readers, store
from placescope.streaming import jobs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_append_is_idempotent_and_keeps_current_rows(spark):
    cur = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 9.0, "x"), ("c", 3.0, "y")], "k string, v double, extra string")
    once = tables.append_new(cur, new, "k")
    assert rows(once, "k", "v") == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    assert rows(tables.append_new(once, new, "k"), "k", "v") == rows(once, "k", "v")


def test_merge_without_key_column_changes_nothing(spark):
    repo = spark.createDataFrame([("a",)], "k string")
    backup = spark.createDataFrame([("",), (None,), ("b",)], "k string")
    assert rows(tables.merge_authoritative(repo, backup, "k"), "k") == [("a",), ("b",)]
    assert tables.merge_authoritative(repo, backup.toDF("other"), "k") is repo


def test_update_ignores_nulls_and_new_keys(spark):
    cur = spark.createDataFrame([("a", 1.0, "p"), ("b", 2.0, "q")], "k string, v double, w string")
    new = spark.createDataFrame([("a", None), ("b", 5.0), ("z", 7.0)], "k string, v double")
    assert rows(tables.update_existing(cur, new, "k"), "k", "v", "w") == [("a", 1.0, "p"), ("b", 5.0, "q")]


def test_upsert_and_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    assert store.read_current(spark, base) is None
    first = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "k string, v int, at int")
    store.commit(first, base)
    new = spark.createDataFrame([("a", 2, 10), ("b", 2, 5), ("c", 2, 1)], "k string, v int, at int")
    done = store.commit(tables.upsert_latest(store.read_current(spark, base), new, "k", "at"), base)
    assert rows(done, "k", "v") == [("a", 2), ("b", 1), ("c", 2)]
    assert rows(store.read_current(spark, base), "k", "v") == rows(done, "k", "v")


def test_bad_rows_are_counted_and_an_older_incoming_row_wins(spark):
    raw = spark.createDataFrame(
        [("a", "1.5", "None", 1), ("a", "2.5", " ", 2), ("b", "x", "3", 3), ("c", None, "3", 4), ("d", "4", "y", 5), ("e", "1e400x", None, 6), (None, "1", "2", 7), ("f", "7", "8", 8)],
        "k string, lat string, spend string, n int",
    )
    good, bad = tables.valid_rows(raw, {"lat": "double"}, {"spend": "double"})
    assert rows(bad, "k", "bad_column") == [("b", "lat"), ("c", "lat"), ("d", "spend"), ("e", "lat")]
    cur = spark.createDataFrame([("a", 9.0, 9.0, 99), ("z", 1.0, None, 99)], "k string, lat double, spend double, n int")
    assert sorted(map(tuple, tables.upsert(cur, good, "k", F.col("n")).collect())) == [("a", 2.5, None, 2), ("f", 7.0, 8.0, 8), ("z", 1.0, None, 99)]
    assert rows(tables.upsert(cur, good.limit(0), "k", F.col("n")), "k") == [("a",), ("z",)]


def test_log_rows_with_bad_figures_are_skipped(spark):
    raw = spark.createDataFrame(
        [("2026-01-01T00:00:00Z", "k1", "s", "1,200"), ("bad", "k2", "s", "1"), ("2026-01-01T00:00:00+00:00", "k3", "s", "x"),
         ("2026-01-01T00:00:00Z", "k4", "s", None)],
        "ts string, k string, source string, income string",
    )
    assert rows(tables.parse_log(raw, "ts", "k", "source", ["income"]).fillna(-1.0), "k", "income") == [("k1", 1200.0), ("k4", -1.0)]


def test_missing_signal_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,rate,other\n011001,1.5,x\n110002,-,y\n")
    got = readers.read_signal(spark, str(tmp_path / "a.csv"), "rate double", "code", ["rate"])
    assert {(r["code"], r["rate"]) for r in got.collect()} == {("011001", 1.5), ("110002", None)}
    assert readers.read_signal(spark, str(tmp_path / "a.csv"), "zzz double", "code", ["zzz"]) is None
    assert readers.read_signal(spark, str(tmp_path / "none.csv"), "rate double", "code", ["rate"]) is None


def test_ragged_pipe_rows(spark, tmp_path):
    head = "|".join(f"h{i}" for i in range(5))
    (tmp_path / "x1.csv").write_text(f'{head}\na|b|c|d|"e | ""f"" 411001"\nshort|row\n')
    (tmp_path / "x2.csv").write_text(f"{head}\n1|2|3|4|5|6\n")
    got = readers.read_piped(spark, str(tmp_path / "x*.csv"), 5, {"first": 0, "last": 4})
    assert rows(got, "first", "last") == [("1", "5"), ("a", 'e | "f" 411001')]


def test_sections_headers_and_html(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("# note\nx,1\n  # district,code,rate\nPune,MH,0.5\n# c\n\nbad\nSurat,GJ,oops\n")
    got = readers.read_section(spark, str(tmp_path / "s"), "district,code,rate", {"d": "string", "c": "string", "r": "double"})
    assert {(r["d"], r["r"]) for r in got.collect()} == {("Pune", 0.5), ("Surat", None)}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.txt").write_text("TABLE 1: STATE-WISE TOTALS OF EVERYTHING UNDER THE SUN\nno,State/UT,Schools,Total schools\n1,Goa,x,7\n2,,x,8\n")
    grid = readers.read_grids(spark, str(tmp_path / "g"), "state", {"state": ("state", "state/ut"), "n": ("schools", "total schools")})
    assert rows(grid, "state", "n") == [("Goa", "7")]
    html = "<h2>Goa (GA)[edit]</h2><p/><table class='wikitable'><tr><th>District</th></tr><tr><td>North <b>Goa</b>[3]</td></tr></table><h3>Notes</h3><table class='wikitable'><tr><td>no</td></tr></table>"
    page = spark.createDataFrame([(1, html)], "id int, html string")
    got = readers.tables_by_heading(page, "html", r"^[A-Za-z ]+ \([A-Z]{2}\)", ["id"]).collect()
    assert [r["cells"] for r in sorted(got, key=lambda r: r["row"])] == [["District"], ["North Goa"]]


def test_geojson_mixed_depths(spark, tmp_path):
    ring = [[77.0, 12.0], [77.1, 12.0], [77.1, 12.1], [77.0, 12.0]]
    features = [
        {"type": "Feature", "properties": {"code": "1"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"code": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"type": "Feature", "properties": {"code": "3"}, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = readers.read_geojson(spark, str(tmp_path / "b.json"), "code")
    assert {(r["code"], len(r["parts"])) for r in got.collect()} == {("1", 1), ("2", 2)}


def test_payload_takes_last_total(spark):
    doc = {"data": {"hoverDataList": [
        {"name": "x district", "metric": [{"type": "TOTAL", "amount": 1.0}, {"type": "TOTAL", "amount": 2.0}]},
        {"name": "y district", "metric": [{"type": "OTHER", "amount": 9.0}]},
    ]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "p string")
    assert rows(readers.explode_payload(df, "p", []), "name", "amount") == [("x district", 2.0), ("y district", 0.0)]


def test_modal_ties_and_latest_value(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "c"), ("k", "b"), ("k", "a")], "k string, l string")
    assert rates.modal(df, "k", "l", "m").first()["m"] == "a"
    facts = spark.createDataFrame(
        [("Gini index (x)", 2001, 1.0), ("Gini index (x)", 2005, None), ("GDP", 2000, 5.0), ("GDP growth", 2010, 6.0)],
        "n string, y int, v double",
    )
    got = {r["wanted"]: (r["y"], r["v"]) for r in rates.latest_value(facts, ["Gini index", "GDP", "none"], "n", "y", "v").collect()}
    assert got == {"Gini index": (2001, 1.0), "GDP": (2000, 5.0)}


def test_carry_down_and_donor(spark):
    lines = spark.createDataFrame([("f", 0, "A", None), ("f", 1, None, 1), ("f", 2, None, 2), ("f", 3, "B", None), ("f", 4, None, 3)], "file string, pos int, label string, v int")
    got = rates.carry_down(lines, "file", "pos", "label", "state").where("v is not null")
    assert rows(got, "state", "v") == [("A", 1), ("A", 2), ("B", 3)]
    filled = rates.donor_fill(spark.createDataFrame([("A", 1)], "k string, v int"), "k", "T", "A")
    assert rows(filled, "k", "v") == [("A", 1), ("T", 1)]


def test_carry_down_over_ranges_equals_one_walk(spark):
    rnd = random.Random(5)
    lines = [(f, p, rnd.choice("AB") if rnd.random() < 0.1 else None) for f in ("x", "y", None) for p in rnd.sample(range(-50, 400), 200)]
    want, last = [], {}
    for f, p, label in sorted(lines, key=lambda r: (r[0] or "", r[1])):
        last[f] = label or last.get(f)
        want.append((f, p, last[f]))
    df = spark.createDataFrame(lines, "file string, pos long, label string")
    for size in (7, 1000):
        got = rates.carry_down(df, "file", "pos", "label", "state", size)
        assert got.columns == ["file", "pos", "label", "state"]
        assert sorted(((r.file, r.pos, r.state) for r in got.collect()), key=lambda r: (r[0] or "", r[1])) == want
    assert rates.carry_down(df.limit(0), "file", "pos", "label", "state").count() == 0


def test_log_stream_replays_add_nothing(spark, tmp_path):
    land, base, check = (str(tmp_path / n) for n in ("land", "log", "check"))
    one = spark.createDataFrame([(1, "2026-01-05 00:00:00", "a"), (2, "2026-01-05 00:00:00", "b")], "id int, t string, s string")
    one = one.select("id", F.col("t").cast("timestamp").alias("ts"), "s")
    one.write.parquet(land)
    schema = spark.read.parquet(land).schema
    run = lambda: jobs.ingest_log(jobs.read_log(spark, land, schema), base, check, ["ts", "s"], "id")
    run()
    assert spark.read.parquet(base).count() == 2
    # A repeat of one row and an event far older than everything seen before.
    late = spark.createDataFrame([(3, "2020-01-01 00:00:00", "a"), (4, "2026-01-05 00:00:00", "b")], "id int, t string, s string")
    late.select("id", F.col("t").cast("timestamp").alias("ts"), "s").write.mode("append").parquet(land)
    run()
    run()
    assert rows(spark.read.parquet(base), "id") == [(1,), (2,), (3,)]


def test_fresh_checkpoint_over_a_stored_log(spark, tmp_path):
    land, base = str(tmp_path / "land"), str(tmp_path / "log")
    days = spark.range(6).select(F.col("id").cast("int"), F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 3 AS int))").alias("ts"), F.lit("a").alias("s"))
    days.withColumn("s", F.col("id").cast("string")).write.parquet(land)
    schema = spark.read.parquet(land).schema
    for check in ("one", "two"):
        jobs.ingest_log(jobs.read_log(spark, land, schema), base, str(tmp_path / check), ["ts", "s"], "id")
    more = days.select((F.col("id") + 10).alias("id"), "ts", F.lit("new").alias("s")).limit(1)
    more.write.mode("append").parquet(land)
    jobs.ingest_log(jobs.read_log(spark, land, schema), base, str(tmp_path / "three"), ["ts", "s"], "id")
    assert sorted(r.id for r in jobs.stored(spark, base).collect())[:6] == [0, 1, 2, 3, 4, 5]
    assert jobs.stored(spark, base).count() == 7


def test_commit_refuses_a_taken_version(spark, tmp_path):
    base = str(tmp_path / "t")
    one = spark.createDataFrame([(1,)], "k int")
    store.commit(one, base)
    store._claim(spark, f"{base}/v000002")
    with pytest.raises(store.VersionTaken):
        store.commit(one, base)
    assert store.read_current(spark, base).count() == 1
    other = str(tmp_path / "u")
    for k in range(3):
        store.update(spark, other, lambda now, k=k: spark.createDataFrame([(k,)], "k int") if now is None else now.union(spark.createDataFrame([(k,)], "k int")))
    assert rows(store.read_current(spark, other), "k") == [(0,), (1,), (2,)]

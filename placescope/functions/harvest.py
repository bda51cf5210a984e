"""Column functions that pull fields out of whole document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placescope.functions import fixed_values as fixed
from placescope.functions.names import bound, contains_any


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, trimmed; null when it does not occur."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def amount(text: Column, pattern: str) -> Column:
    return F.replace(first_match(text, pattern), F.lit(","), F.lit("")).try_cast("double")


def unit_factor(unit: Column) -> Column:
    """Square feet per unit; an unknown unit counts as square feet."""
    key = F.regexp_replace(F.lower(unit), r"[.\s]", "")
    pairs = [F.lit(x) for k, v in fixed.UNIT_SQFT.items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(1.0))


def land_record(df: DataFrame, text: str) -> DataFrame:
    """Rate per square foot: stated, else amount over area inside the plausible band."""
    t = F.col(text)
    area = amount(t, fixed.AREA_PATTERN) * unit_factor(first_match(t, fixed.AREA_PATTERN, 2))
    df = df.withColumns(
        {"_stated": amount(t, fixed.RATE_PATTERN), "_amount": amount(t, fixed.AMOUNT_PATTERN), "_area": area}
    )
    usable = (F.col("_amount") > 0) & (F.col("_area") > 0)
    df = df.withColumn("_derived", F.when(usable, F.col("_amount") / F.col("_area")))
    medium = F.col("_stated").isNull() & F.col("_derived").between(fixed.RATE_MIN, fixed.RATE_MAX)
    return df.withColumns(
        {
            "rate_per_sqft": F.when(medium, F.bround("_derived", 0)).otherwise(F.col("_stated")),
            "transaction_value": F.when(medium, F.col("_amount")),
            "area_sqft": F.when(medium, F.bround("_area", 0)),
            "confidence": F.when(F.col("_stated").isNotNull(), "high").when(medium, "medium").otherwise("low"),
        }
    ).drop("_stated", "_amount", "_area", "_derived")


def vehicle_record(df: DataFrame, text: str) -> DataFrame:
    """Fuel, class, owner code, price and luxury flag of a vehicle certificate text."""
    t = F.col(text)
    df = df.withColumns(
        {
            "fuel_type": F.initcap(F.lower(first_match(t, fixed.FUEL_PATTERN))),
            "vehicle_class": F.upper(first_match(t, fixed.CLASS_PATTERN)),
            "owner_code": first_match(t, fixed.OWNER_CODE_PATTERN),
            "price": amount(t, fixed.PRICE_PATTERN),
        }
    )
    brand = bound(F.lower(t), lambda low: contains_any(low, fixed.LUXURY_BRANDS))
    dear = F.coalesce(F.col("price") >= fixed.LUXURY_PRICE, F.lit(False))
    return df.withColumn("is_luxury", brand | dear)


# Field patterns of a property tax receipt.
_MONEY = r"([\d,]+\.?\d*)"
_NUMBER = r"([\d.]+)"
RECEIPT_AMOUNTS = {
    "property_tax": r"(?i)Property Tax\s+" + _MONEY,
    "cesses": r"(?i)Cesses\s+" + _MONEY,
    "total_tax": r"(?i)Total Tax\s+" + _MONEY,
    "penalty": r"(?i)Penalty\s+" + _MONEY,
    "interest": r"(?i)Interest\s+" + _MONEY,
    "swm_cess": r"(?i)SWM Cess[^\d]*" + _MONEY,
    "net_tax_paid": r"(?i)Net Tax to be\s*Paid\s+" + _MONEY,
}
RECEIPT_ROW = r"(\d{4}-\d{4})" + (r"\s+" + _NUMBER) * 8
RECEIPT_ROW_POSITION = {
    "property_tax": 1, "cesses": 2, "total_tax": 3, "penalty": 5, "interest": 6, "swm_cess": 7,
    "net_tax_paid": 8,
}
RECEIPT_WARD = (
    r"(?:\d{8,})\s+(\d{1,3})\s*[-–]\s*([A-Z][A-Z ]+?)(?=\s+\(cid:|[^\x00-\x7F])",
    r"\b(\d{1,3})\s*[-–]\s*([A-Z]{2}[A-Z ]+?)(?=\s+\(cid:|\s+[^\x00-\x7F])",
)
RECEIPT_TEXT = {
    "zone": (
        r"(?is)Residential zone classification\s+([A-F])\b", r"(?is)zone classification\s+([A-F])\b",
    ),
    "receipt_no": (r"(?is)Receipt\s*No\.?\s*[:\-]?\s*(\d{8,})",),
    "date": (r"(?is)Date\s*[:\-]?\s*(\d{1,2}[-/]\d{2}[-/]\d{4})",),
    "year": (r"(?is)Tax Paid Year\s*[:\-]?\s*(\d{4}-\d{4})", r"(?m)^(\d{4}-\d{4})"),
}
RECEIPT_STREET = r"(\d+\s+[A-Z][a-zA-Z]+.{5,80}(?:LAYOUT|NAGAR|MAIN|CROSS|ROAD|COLONY))"
RECEIPT_ADDRESS = r"(?is)Property Address\s*[:\-]\s*(.+?)(?=\s+(?:Survey No|Old PID|\d/\d)|$)"


def tax_receipt(df: DataFrame, text: str) -> DataFrame:
    """Fields of a tax receipt; amounts fall back to the summary row when none is labelled.

    Every pattern runs once per text, into a column of its own; the rules then read the columns.
    """
    t = F.col(text)
    raw = {f"_{n}_{i}": first_match(t, p) for n, ps in RECEIPT_TEXT.items() for i, p in enumerate(ps)}
    raw |= {f"_ward_{i}": F.regexp_extract(t, p, 0) for i, p in enumerate(RECEIPT_WARD)}
    raw |= {f"_label_{n}": F.regexp_extract(t, p, 1) for n, p in RECEIPT_AMOUNTS.items()}
    raw |= {
        "_street": F.trim(F.regexp_extract(t, RECEIPT_STREET, 1)),
        "_rest": F.trim(F.regexp_extract(t, RECEIPT_ADDRESS, 1)),
        "_row": F.split(F.regexp_extract(t, RECEIPT_ROW, 0), r"\s+"),
    }
    found = df.withColumns(raw)
    empty = F.lit("")
    fields = {
        n: F.coalesce(*[F.col(f"_{n}_{i}") for i in range(len(ps))], empty) for n, ps in RECEIPT_TEXT.items()
    }
    # The second ward pattern only counts where the first does not match at all.
    ward = F.when(F.col("_ward_0") != "", F.col("_ward_0")).otherwise(F.col("_ward_1"))
    number_name = r"(\d{1,3})\s*[-–]\s*([A-Z][A-Z ]*)$"
    fields["ward_no"] = F.regexp_extract(ward, number_name, 1)
    fields["ward_name"] = F.regexp_replace(F.trim(F.regexp_extract(ward, number_name, 2)), r"[-–\s]+$", "")
    street, rest = F.col("_street"), F.col("_rest")
    both = (street != "") & (rest != "") & ~F.contains(street, rest)
    address = F.when(both, F.concat(street, F.lit(", "), rest)).otherwise(
        F.when(street != "", street).otherwise(rest)
    )
    fields["property_address"] = F.trim(F.regexp_replace(address, r"\s+", " "))
    labelled = {
        n: F.coalesce(F.replace(F.col(f"_label_{n}"), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
        for n in RECEIPT_AMOUNTS
    }
    by_row = (labelled["property_tax"] == 0) & (F.size("_row") > 8)
    for n, position in RECEIPT_ROW_POSITION.items():
        fields[n] = F.when(by_row, F.get("_row", F.lit(position)).try_cast("double")).otherwise(labelled[n])
    out = found.withColumns(fields).drop(*raw)

    def of_zone(i: int, kind: str) -> Column:
        pairs = [F.lit(x) for z, v in fixed.ZONES.items() for x in (z, v[i])]
        return F.element_at(F.create_map(*pairs), F.col("zone")).cast(kind)

    return out.withColumns(
        {
            "area_hint": F.trim(F.split("property_address", ",")[0]),
            "zone_label": F.coalesce(of_zone(0, "string"), empty),
            "index_low": of_zone(1, "int"),
            "index_high": of_zone(2, "int"),
        }
    )


def region_rows(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per region/number/number line in a report text; the last line of a region wins."""
    matches = F.regexp_extract_all(F.col(text), F.lit(fixed.REGION_ROW_PATTERN), 0)
    line = df.select(*keep, F.posexplode(matches).alias("_pos", "_line"))

    def number(i: int) -> Column:
        found = F.regexp_extract("_line", fixed.REGION_ROW_PATTERN, i)
        return F.replace(found, F.lit(","), F.lit("")).try_cast("double")

    region = F.lower(F.trim(F.regexp_extract("_line", fixed.REGION_ROW_PATTERN, 1)))
    rows = line.select(
        *keep,
        "_pos",
        F.replace(region, F.lit("  "), F.lit(" ")).alias("region"),
        number(2).alias("volume"),
        number(3).alias("amount"),
    )
    last = F.max_by(F.struct("volume", "amount"), F.col("_pos"))
    return rows.groupBy(*keep, "region").agg(last.alias("_p")).select(*keep, "region", "_p.*")


def year_guess(text: Column) -> Column:
    labelled = first_match(text, fixed.YEAR_LABEL_PATTERN)
    return F.coalesce(labelled, first_match(text, fixed.YEAR_PATTERN), F.lit(""))

"""Column functions for place names, codes in text, and keyword classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from placescope.functions import fixed_values as fixed


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Constant map lookup, null where the key is absent."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), key)


def aliased(table: Mapping[str, str], key: Column) -> Column:
    return F.coalesce(lookup(table, key), key)


def norm_region(name: Column, aliases: Mapping[str, str] = fixed.REGION_ALIASES) -> Column:
    """Upper case, trailing stars gone, & to AND, single spaces, alias."""
    s = F.regexp_replace(F.trim(F.upper(name)), r"\*+$", "")
    s = F.regexp_replace(s, r"\s*&\s*", " AND ")
    return aliased(aliases, F.trim(F.regexp_replace(s, r"\s+", " ")))


def squeeze_group(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))


def norm_group(
    name: Column, region: Column, aliases: Mapping[str, str] = fixed.GROUP_ALIASES
) -> Column:
    """Group name in match form: alphanumerics, no DISTRICT suffix, capital suffix rule, alias."""
    s = F.regexp_replace(squeeze_group(name), " DISTRICT$", "")
    lacks_suffix = (region == "DELHI") & ~s.endswith("DELHI") & (s != "SHAHDARA")
    return aliased(aliases, F.when(lacks_suffix, F.concat(s, F.lit(" DELHI"))).otherwise(s))


def fold_place(name: Column) -> Column:
    """Parentheses dropped, only a-z and digits kept, spelling folded."""
    s = F.regexp_replace(name, r"\([^)]*\)", "")
    s = F.regexp_replace(F.lower(s), "[^a-z0-9]", "")
    return F.replace(s, F.lit("bengaluru"), F.lit("bangalore"))


def clean_office(name: Column, office_type: Column) -> Column:
    """Office name without its type suffix and trailing parenthetical, at two nesting levels."""
    suffix = F.concat(F.lit(" "), office_type)
    s = F.when(name.endswith(suffix), F.left(name, F.length(name) - F.length(suffix))).otherwise(name)
    for pattern in (r"\s*\([^)]*\)\s*$", r"\s+[A-Z]\.?O\.?\s*$") * 2:
        s = F.trim(F.regexp_replace(s, pattern, ""))
    return F.coalesce(F.nullif(s, F.lit("")), name)


def trailing_code(text: Column) -> Column:
    """Six digits at the end of a text, a closing quote allowed; null when absent."""
    return F.nullif(F.regexp_extract(F.trim(text), r'(\d{6})\s*"?\s*$', 1), F.lit(""))


def codes_in(text: Column) -> Column:
    """All stand-alone six-digit codes with a first digit 1-9."""
    return F.regexp_extract_all(text, F.lit(r"\b([1-9]\d{5})\b"), 1)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words occurs: plain substring search, far cheaper than an alternation."""
    hit = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def bound(value: Column, use) -> Column:
    """``use`` applied to a value computed once, whatever number of times ``use`` refers to it."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def classify(
    text: Column, classes: Sequence[tuple[str, Sequence[str]]] = fixed.OFFICE_CLASSES
) -> Column:
    """Name of the first class with a keyword in the lower-cased text, else empty."""

    def first_class(t: Column) -> Column:
        found = F.lit("")
        for name, words in reversed(classes):
            found = F.when(contains_any(t, words), name).otherwise(found)
        return found

    return bound(F.lower(text), first_class)


def tag_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def is_luxury(
    maker: Column,
    price: Column | None = None,
    words: Sequence[str] = fixed.LUXURY_BRANDS,
    threshold: float = fixed.LUXURY_PRICE,
) -> Column:
    lowered = [w.lower() for w in words]
    hit = F.coalesce(bound(F.lower(maker), lambda m: contains_any(m, lowered)), F.lit(False))
    return hit if price is None else hit | F.coalesce(price >= threshold, F.lit(False))


def region_of(
    key: Column,
    explicit: Mapping[str, str] | None = None,
    prefixes: Mapping[str, str] = fixed.PREFIX_REGION,
    unknown: str = fixed.UNKNOWN_REGION,
) -> Column:
    by_prefix = F.coalesce(lookup(prefixes, F.substring(key, 1, 2)), F.lit(unknown))
    return F.coalesce(lookup(explicit, key), by_prefix) if explicit else by_prefix


def parse_number(text: Column) -> Column:
    """Number with thousands commas and [footnotes]; null when it is none."""
    s = F.regexp_replace(text, r"\[\d+\]", "")
    return F.trim(F.replace(s, F.lit(","), F.lit(""))).try_cast("double")


def digits_number(text: Column) -> Column:
    """Number after dropping everything but digits and dots; 0 when nothing is left."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d.]", "")
    return F.coalesce(kept.try_cast("double"), F.lit(0.0))


def coerce_number(text: Column) -> Column:
    """Text to a finite double, null for empty, NaN, infinities and non-numbers."""
    v = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, v)


def display_name(group: Column, region: Column, key: Column) -> Column:
    """Title-cased group and region plus the key, which makes it unique."""
    return F.concat(
        F.initcap(F.lower(group)), F.lit(", "), F.initcap(F.lower(region)), F.lit(" · "), key
    )


def synthetic_key(name: Column, lat: Column, lng: Column) -> Column:
    """Stable key for a keyless point: D and all 128 bits of a hash of name and micro-degrees."""
    micro = lambda v: F.round(v * 1_000_000).cast("bigint").cast("string")
    return F.concat(F.lit("D"), F.md5(F.concat_ws("|", name, micro(lat), micro(lng)).cast("binary")))


def fix_band(band: Column) -> Column:
    return F.trim(aliased(fixed.BAND_FIXES, band))


TOTAL_ROW = r"(?i)all.india|region\s*$|^total|^note|^source"


def is_total_row(label: Column) -> Column:
    return label.rlike(TOTAL_ROW)

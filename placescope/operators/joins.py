"""Key resolution joins: pass-through, precedence, fallback paths, name matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from placescope.functions import fixed_values as fixed
from placescope.functions.names import aliased
from placescope.operators.components import components
from placescope.session import materialize


def downscale(groups: DataFrame, members: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Give every member its group's per-head value; members of unknown groups get null."""
    return members.select(key, group).join(groups.select(group, value), group, "left").select(key, value)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the first in the stated order, by one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), order)
    return df.groupBy(*keys).agg(picked.alias("_p")).select(*keys, "_p.*")


def population_rate(
    totals: DataFrame, population: DataFrame, keys: Sequence[str], total: str, order: Column, unit: float, digits: int
) -> DataFrame:
    """Inner join on the composite key to the first population row of the key; total per unit."""
    pop = first_per_key(population, keys, order)
    rate = F.bround(F.col(total) / F.col("population") * F.lit(float(unit)), digits)
    return totals.join(pop, list(keys)).withColumn("rate", rate)


def apply_key_fixes(df: DataFrame, fixes: Mapping[tuple[str, str], tuple[str, str]], group: str, region: str) -> DataFrame:
    """Replace (group, region) pairs named in a small constant table."""
    g, r = F.col(group), F.col(region)
    new_g, new_r = g, r
    for (old_g, old_r), (to_g, to_r) in fixes.items():
        hit = (g == old_g) & (r == old_r)
        new_g, new_r = F.when(hit, F.lit(to_g)).otherwise(new_g), F.when(hit, F.lit(to_r)).otherwise(new_r)
    return df.withColumns({group: new_g, region: new_r})


def two_path(
    curated: DataFrame,
    directory: DataFrame,
    crosswalk: DataFrame,
    survey: DataFrame,
    key: str,
    trusted: Sequence[str] = ("exact", "verified_manual"),
    fallthrough: bool = False,
) -> DataFrame:
    """Curated map first; keys outside it through the trusted part of the crosswalk.

    ``curated``: key, group. ``directory``: key, postal. ``crosswalk``: postal, group, match_method.
    ``survey``: group, value. With ``fallthrough`` curated keys without a value also try the
    crosswalk.
    """
    primary = curated.join(survey, "group", "left").select(key, "group", "value")
    settled = primary if not fallthrough else primary.where("value is not null")
    bridge = crosswalk.where(F.col("match_method").isin(*trusted)).select("postal", "group")
    second = (
        directory.join(settled.select(key), key, "left_anti")
        .join(bridge, "postal")
        .join(survey, "group")
        .select(key, "group", "value")
    )
    second = first_per_key(second, [key], F.col("group"))
    if fallthrough:
        open_keys = primary.where("value is null").join(second.select(key), key, "left_anti")
        return settled.unionByName(second).unionByName(open_keys)
    return primary.unionByName(second)


def prefer_first(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Outer join taking a's attributes where present, else b's; rows lacking a required one go."""
    joined = a.alias("a").join(b.alias("b"), key, "full")
    picked = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in columns]
    return joined.select(key, *picked).dropna(subset=list(required))


def uniform_lookup(members: DataFrame, known: DataFrame, figures: DataFrame, key: str, region: str, order: Column) -> DataFrame:
    """Region figures applied to every known member key, one row per key."""
    rows = members.join(known.select(key), key, "left_semi").join(figures, region)
    return first_per_key(rows, [key], order)


def tiered(base: DataFrame, key: str, tiers: Sequence[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """First non-null of several sources: (figures, join column, value column) by precedence."""
    picks = []
    for i, (figures, on, value) in enumerate(tiers):
        name = f"_t{i}"
        base = base.join(figures.select(on, F.col(value).alias(name)), on, "left")
        picks.append(F.col(name))
    return base.withColumn(out, F.coalesce(*picks)).drop(*[f"_t{i}" for i in range(len(tiers))])


def keyword_lookup(texts: DataFrame, text: str, words: Sequence[str], out: str) -> DataFrame:
    """First listed keyword that each text contains, also inside a word; null where none is.

    Texts and keywords are compared in lower case. The list is a parameter and becomes one row-local
    expression: nothing is shuffled.
    """
    low = F.lower(F.col(text))
    found = F.lit(None).cast("string")
    for word in reversed(words):
        found = F.when(low.contains(word.lower()), F.lit(word)).otherwise(found)
    return texts.withColumn(out, found)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(b, a)], dtype="float64")


name_ratio = F.pandas_udf(_ratios, DoubleType())


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Best pairs first, each name used once; ties go by left, then right name.

    Names that hang together by pairs form a component, and components do not touch one another, so
    each is settled on its own in one grouped step. Above a high cutoff they hold a few spellings of
    one name. The number of jobs grows with the logarithm of the longest chain of names.
    """
    pairs = materialize(pairs, "open-pairs")
    links = pairs.select(F.concat(F.lit("l"), left).alias("a"), F.concat(F.lit("r"), right).alias("b"))
    labels = components(links).select(F.col("node").alias("_node"), "label")
    labelled = pairs.join(labels, F.concat(F.lit("l"), left) == F.col("_node")).drop("_node")

    columns = list(pairs.columns)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        used_left, used_right, keep = set(), set(), []
        for at, l, r in group.sort_values(["ratio", left, right], ascending=[False, True, True])[[left, right]].itertuples(name=None):
            if l not in used_left and r not in used_right:
                used_left.add(l)
                used_right.add(r)
                keep.append(at)
        return group.loc[keep, columns]

    return labelled.groupBy("label").applyInPandas(settle, pairs.schema)


def match_names(
    left: DataFrame,
    right: DataFrame,
    aliases: Mapping[str, str] = fixed.PLACE_ALIASES,
    cutoff: float = fixed.FUZZY_CUTOFF,
) -> DataFrame:
    """Match folded names: exact, then alias, then similarity at or above the cutoff.

    ``left(left_name)`` and ``right(right_name)`` hold distinct names; each side is used once.
    """
    exact = left.join(right, F.col("left_name") == F.col("right_name")).withColumn("tier", F.lit("exact"))
    l_rest = left.join(exact.select("left_name"), "left_name", "left_anti")
    r_rest = right.join(exact.select("right_name"), "right_name", "left_anti")
    by_alias = (
        l_rest.withColumn("_a", aliased(aliases, F.col("left_name")))
        .join(r_rest, F.col("_a") == F.col("right_name"))
        .drop("_a")
        .withColumn("tier", F.lit("alias"))
    )
    by_alias = first_per_key(by_alias, ["right_name"], F.col("left_name"))
    l_rest = l_rest.join(by_alias.select("left_name"), "left_name", "left_anti")
    r_rest = r_rest.join(by_alias.select("right_name"), "right_name", "left_anti")
    fuzzy = fuzzy_candidates(l_rest, r_rest, cutoff)
    fuzzy = one_to_one(fuzzy, "left_name", "right_name").withColumn("tier", F.lit("fuzzy"))
    cols = ["left_name", "right_name", "tier"]
    return exact.select(*cols).unionByName(by_alias.select(*cols)).unionByName(fuzzy.select(*cols))


def fuzzy_candidates(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """All pairs with similarity >= cutoff, found without comparing all names.

    With M characters matched in order the ratio is 2M / (la + lb). At a cutoff c at most
    (1 - c)(la + lb) characters are inserted or deleted, and lb is at most la (2 - c) / c, so there
    are at most e = 2 (1 - c) la / c edits. Of e + 1 pieces of the left name one stays whole, and it
    starts in the right name within e of its own place. An equi-join on (piece, place) is therefore
    a complete candidate set, and the exact ratio decides.
    """
    reach = (2 - cutoff) / cutoff
    la = F.length("left_name")
    edits = F.floor(F.lit(2 * (1 - cutoff) / cutoff) * la + 1e-9).cast("int")
    left = left.where(la > 0).withColumn("_e", edits).withColumn("_la", la)
    cut = lambda i: F.floor(i * F.col("_la") / (F.col("_e") + 1)).cast("int")
    pieces = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.col("_e")),
            lambda i: F.struct(
                F.substring(F.col("left_name"), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"),
                cut(i).alias("at"),
            ),
        ),
        lambda p: p["piece"] != "",
    )
    placed = F.flatten(
        F.transform(
            pieces,
            lambda p: F.transform(
                F.sequence(F.greatest(F.lit(0), p["at"] - F.col("_e")), p["at"] + F.col("_e")),
                lambda at: F.struct(p["piece"].alias("piece"), at.alias("at")),
            ),
        )
    )
    left = left.select("left_name", "_la", F.explode(F.array_distinct(placed)).alias("_p")).select(
        "left_name", "_la", "_p.piece", "_p.at"
    )
    right = right.withColumn("_widths", left.agg(F.collect_set(F.length("piece"))).scalar())
    lb = F.length("right_name")
    grams = F.flatten(
        F.transform(
            F.filter(F.col("_widths"), lambda m: m <= lb),
            lambda m: F.transform(
                F.sequence(F.lit(0), lb - m),
                lambda at: F.struct(
                    F.substring(F.col("right_name"), at + 1, m).alias("piece"), at.alias("at")
                ),
            ),
        )
    )
    right = right.select("right_name", lb.alias("_lb"), F.explode(grams).alias("_p")).select(
        "right_name", "_lb", "_p.piece", "_p.at"
    )
    near = F.greatest("_la", "_lb") <= F.least("_la", "_lb") * F.lit(reach) + 1e-9
    pairs = left.join(right, ["piece", "at"]).where(near).select("left_name", "right_name").distinct()
    # The ratio leaves (1 - c)(la + lb) characters unmatched at most, and so many edits suffice.
    total = F.length("left_name") + F.length("right_name")
    pairs = pairs.where(F.levenshtein("left_name", "right_name") <= F.lit(1 - cutoff) * total + 1e-9)
    return pairs.withColumn("ratio", name_ratio("left_name", "right_name")).where(
        F.col("ratio") >= cutoff
    )

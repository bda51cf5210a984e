r"""Operator 5: quality rules as a short-circuit cascade. DataFrame functions only.

Words are runs ``[^\x20\x09-\x0D]+``. The base figures are plain columns; the further rules of the
cascade run in the order of rejections per cost, measured on a bounded sample, and a rule is evaluated
only for rows that all earlier ones let pass. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescope.llm.arrow import narrow

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: How often a rule runs over the sample, and the least time it counts with, in seconds.
REPEAT, LEAST_COST = 20, 1e-3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a window of eight words which the array holds at least twice.

    Windows are compared by a 64-bit hash of their word hashes. Only texts with some equal windows pay
    for sorting them.
    """

    def of_windows(windows: Column) -> Column:
        def covered(places: Column) -> Column:
            gaps = F.zip_with(F.slice(places, 2, F.size(places)), F.slice(places, 1, F.size(places) - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
            return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

        def twins(pairs: Column) -> Column:
            def equal(k: Column, step: int) -> Column:
                return F.coalesce(F.get(pairs, k + step)["h"] == F.get(pairs, k)["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(pairs, lambda x, k: equal(k, -1) | equal(k, 1)), lambda x: x["i"]))

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(pairs, twins), covered)).otherwise(F.lit(0))

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return let(windows, of_windows)

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) > WINDOW, let(hashes, of_hashes)).otherwise(F.lit(0)).cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects a row where ``rejects`` is true; null does not reject. ``sql`` says the same for a check."""

    name: str
    rejects: Column | Callable[[], Column]
    sql: str

    def column(self) -> Column:
        return F.coalesce(self.rejects() if callable(self.rejects) else self.rejects, F.lit(False))


def _letters_upper() -> Column:
    text = F.col("text")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (upper >= 20) & (upper * 10 > F.length(F.regexp_replace(text, "[^A-Za-z]+", "")) * 7)


#: Rules beyond the base ones. Each is far from what running text in any of the languages shows.
RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("word_chars"), "n_symbols * 10 > word_chars"),
    Rule("duplicate_lines", lambda: F.col("n_dup_lines") * 2 > F.size(lines(F.col("text"))), "n_dup_lines * 2 > n_lines"),
    Rule("long_words", lambda: F.col("word_chars") > F.col("n_words") * 25, "word_chars > n_words * 25"),
    Rule("short_words", lambda: F.col("word_chars") * 2 < F.col("n_words") * 3, "word_chars * 2 < n_words * 3"),
    Rule(
        "upper_case",
        _letters_upper,
        "length(regexp_replace(text, '[^A-Z]+', '', 'g')) >= 20 AND length(regexp_replace(text, '[^A-Z]+', '', 'g')) * 10 > length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) * 7",
    ),
    Rule(
        "bullet_lines",
        lambda: (F.size(lines(F.col("text"))) >= 5) & (F.size(F.filter(lines(F.col("text")), lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))) * 10 > F.size(lines(F.col("text"))) * 9),
        "n_lines >= 5 AND n_bullets * 10 > n_lines * 9",
    ),
    Rule("ellipses", lambda: count_of(F.col("text"), "…") * 5 > F.col("n_words"), "(length(text) - length(replace(text, '…', ''))) * 5 > n_words"),
)


def base_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = narrow(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text, tokens = F.col("text"), words(F.col("text"))
    return d.select(
        "doc_id",
        "text",
        let(tokens, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("of_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "text", "of_words.n_words", "word_chars", "n_symbols", "n_dup_lines", "of_words.n_repeat_words")


def sampled(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> DataFrame:
    """About ``rows`` random rows, at most twice as many, chosen before any figure is computed."""
    d = narrow(docs, id_col, text_col)
    n = d.count()
    return d.sample(min(1.0, rows / n), seed).limit(2 * rows) if n > rows else d


def ordered(figures: DataFrame, rules: tuple[Rule, ...] = RULES, clock: Callable[[], float] = time.perf_counter, repeat: int = REPEAT) -> list[Rule]:
    """The rules by rejections per second on the sample ``figures``, best first.

    Each rule runs over the sample ``repeat`` times in one job, and the time of a job without a rule is
    taken off. Ties keep the given order; on an empty sample the given order stays. The sample is only
    used for the order, every rule is applied to every row.
    """
    sample = figures.persist()
    try:
        sample.count()
        often = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

        def timed(column: Column) -> tuple[float, int]:
            began = clock()
            rejected = often.agg(F.count_if(column).alias("n")).first()["n"]
            return clock() - began, rejected

        timed(F.col("again") < 0)  # compiles
        fixed, _ = timed(F.col("again") < 0)
        rank = []
        for k, rule in enumerate(rules):
            cost, rejected = timed(rule.column())
            rank.append((-rejected / max(cost - fixed, LEAST_COST), k))
        return [rules[k] for _, k in sorted(rank)]
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base figures, base_failed, kept and the first rule that rejects, for every row of ``docs``.

    A null text counts as empty; it has no words and fails the base. Rows with equal ids are judged one
    by one, a null id stays null, an empty table gives no rows, other columns are ignored.
    """
    figures = base_figures(docs, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = F.when(failed, F.lit("base"))
    for rule in ordered(base_figures(sampled(docs, sample_rows, id_col, text_col)), rules):
        verdict = verdict.when(rule.column(), F.lit(rule.name))
    return figures.withColumn("base_failed", failed).withColumn("rejected_by", verdict).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )


ORACLE = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT r, unnest(list_transform(range(0, 8), lambda k: i + k)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM dup GROUP BY r),
f AS (
  SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*"""
    "•"
    r"""]'))) AS n_bullets
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR """
    + " OR ".join(f"({r.sql})" for r in RULES)
    + """) AS kept
FROM b
"""
)

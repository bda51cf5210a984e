"""Operator 9: language identification by interpolated Kneser-Ney character models.

The 4-grams of all training texts are counted in Spark; the statistics of every order follow from that
table by grouping. A language's model is one sorted array of gram hashes per order with the discounted
probabilities, and one of context hashes with the back-off weights. All grams are kept: beyond
``MAX_ENTRIES`` of them the model stays in Spark tables, which the distinct grams of the texts are joined
with, instead of being sent to the tasks; the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescope.llm.arrow import Lean, give_back, narrow, strings
from placescope.llm.bytehash import mix
from placescope.session import materialize

ORDER = 4
#: Grams of one order, over all languages, up to which the model is broadcast.
MAX_ENTRIES = 1_000_000
#: Digits to which cross-entropies are rounded for the rejection thresholds.
DIGITS = 4
#: Characters that one vectorised step works on; a longer text is a step of its own.
STEP_CHARS = 1_000_000
#: Characters of evidence that the confidence counts at most.
EVIDENCE = 64
UNDETERMINED = "und"
_SPACE = 32


def _alphabetic() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _letters[0]


_letters: list[np.ndarray] = []


@dataclass
class Chars:
    """Texts as one array of code points, letters in lower case and one space for any other run.

    Every text starts with ``ORDER - 1`` spaces; ``ends`` are the places behind each text and ``count``
    the characters to score of each (0: the text has no letter).
    """

    codes: np.ndarray
    starts: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Chars:
        low = [t.lower() for t in texts]
        raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(t) for t in low], dtype=np.int64)
        letter = _alphabetic()[raw]
        codes = np.where(letter, raw, _SPACE).astype(np.uint32)
        row = np.repeat(np.arange(len(low)), size)
        first = np.zeros(len(raw), dtype=bool)
        begin = np.cumsum(size) - size
        first[begin[size > 0]] = True
        keep = letter.copy()
        if len(raw) > 1:
            keep[1:] |= letter[:-1] & ~first[1:]  # the space behind a letter stays
        codes, row = codes[keep], row[keep]
        count = np.bincount(row, minlength=len(low)).astype(np.int64)
        pad = ORDER - 1
        out = np.full(len(codes) + pad * len(low), _SPACE, dtype=np.uint32)
        out[np.arange(len(codes)) + pad * (row + 1)] = codes
        starts = np.cumsum(count + pad) - count
        return cls(out, starts, count)

    def places(self) -> np.ndarray:
        """Place of every character to score."""
        return np.repeat(self.starts - (np.cumsum(self.count) - self.count), self.count) + np.arange(int(self.count.sum()))


def hashes(codes: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place."""
    h = np.full(len(places), n, dtype=np.uint64)
    for back in range(n - 1, -1, -1):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[places - back].astype(np.uint64))
    return h


def _gram_hash(grams: list[str]) -> np.ndarray:
    """The same hash for grams given as strings of equal length."""
    if not grams:
        return np.zeros(0, np.uint64)
    n = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return hashes(codes, np.arange(len(grams)) * n + n - 1, n)


def _steps(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of steps of bounded size."""
    texts, first, size = [], 0, 0
    for n, text in enumerate(strings(batch.column(column)), 1):
        texts.append(text)
        size += len(text)
        if size >= STEP_CHARS or n == batch.num_rows:
            yield first, texts
            texts, first, size = [], n, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, texts in _steps(batch, 0):
            own = langs[first : first + len(texts)]
            for lang in sorted(set(own)):
                chars = Chars.of([t for t, x in zip(texts, own, strict=True) if x == lang])
                places = chars.places()
                if not len(places):
                    continue
                code, unique = pd.factorize(hashes(chars.codes, places, ORDER))
                at = np.zeros(len(unique), dtype=np.int64)
                at[code[::-1]] = places[::-1]
                spelled = np.stack([chars.codes[at - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                grams = [spelled[i : i + ORDER] for i in range(0, len(spelled), ORDER)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(np.bincount(code, minlength=len(unique)), pa.int64())], names=["lang", "gram", "n"]
                )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts with the hashes of their grams and contexts, so that the driver gets numbers only."""
    for batch in batches:
        grams, contexts = (_gram_hash(batch.column(c).to_pylist()) for c in ("gram", "context"))
        context = contexts if len(contexts) and len(batch.column("context")[0].as_py()) else np.zeros(batch.num_rows, np.uint64)
        columns = [batch.column("lang"), pa.array(grams.view(np.int64)), pa.array(context.view(np.int64)), *(batch.column(c) for c in ("n", "total", "kinds"))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "context", "n", "total", "kinds"])


def gram_counts(train: DataFrame) -> DataFrame:
    """Counts of the 4-grams of each language; ``train`` has text and lang, all rows count."""
    rows = train.filter("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(Lean(_count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Order:
    grams: np.ndarray
    discounted: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


Model = dict[str, tuple[list[Order], float]]


@dataclass
class Tables:
    """A model too large to be broadcast; it goes through its languages as a ``Model`` does."""

    uniform: dict[str, float]
    orders: list[tuple[DataFrame, DataFrame]]  # from single characters up: (lang, gram, value), (lang, context, backoff)

    def __iter__(self) -> Iterator[str]:
        return iter(self.uniform)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _discount(n1: int, n2: int) -> float:
    return min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5


def fit(train: DataFrame, max_entries: int = MAX_ENTRIES) -> Model | Tables:
    """Fit one model per language on the text and lang columns of ``train``.

    Discounts are n1 / (n1 + 2 n2) of the order's counts. Below the highest order a gram counts by the
    number of different characters before it. An empty table gives an empty model. All grams are kept;
    with more than ``max_entries`` the model is left in tables.
    """
    counts = materialize(gram_counts(train), "grams")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, large = list(sizes), sum(sizes.values()) > max_entries  # no lower order has more
    model: Model = {}
    level, tables, kept = counts, [], []
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            level = level.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            level = materialize(level, f"grams-{n}") if large else level
        context = F.substring("gram", 1, n - 1) if n > 1 else F.lit("")
        ctx = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        joined = level.select("lang", "gram", "n", context.alias("context")).join(ctx, ["lang", "context"])
        if large:
            few = level.filter("n <= 2").groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
            few = {r["lang"]: (r["n1"], r["n2"]) for r in few.collect()}
            d = F.create_map(*(F.lit(x) for lang in langs for x in (lang, _discount(*few.get(lang, (0, 0))))))[F.col("lang")]
            grams = joined.select("lang", "gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")).alias("value"))
            contexts = ctx.select("lang", "context", (d * F.col("kinds") / F.col("total")).alias("backoff"))
            kept.append((materialize(grams, f"order-{n}"), materialize(contexts, f"contexts-{n}")))
        else:
            tables.append((n, joined.mapInArrow(Lean(_hashed), "lang string, gram long, context long, n long, total long, kinds long").toArrow()))
    if large:
        return Tables({r["lang"]: 1.0 / (r["n"] + 1) for r in sorted(level.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())}, kept[::-1])
    for lang in sorted(langs):
        orders, alphabet = [], 1
        for n, table in reversed(tables):  # from single characters up
            own = table.filter(pc.equal(table["lang"], lang))
            column = lambda name: own[name].to_numpy()  # noqa: B023, E731
            discount = _discount(*(int(np.count_nonzero(column("n") == k)) for k in (1, 2)))
            grams = column("gram").view(np.uint64)
            at = np.argsort(grams)
            value = (np.maximum(column("n") - discount, 0) / column("total"))[at]
            keys, by = np.unique(column("context").view(np.uint64), return_index=True)
            backoff = (discount * column("kinds") / column("total"))[by]
            orders.append(Order(grams[at], value, keys, backoff))
            alphabet = len(own) + 1 if n == 1 else alphabet
        model[lang] = (orders, 1.0 / alphabet)
    del tables
    give_back()
    return model


def _log_probability(orders: list[Order], uniform: float, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    p = np.full(len(grams[0]), uniform)
    for order, gram, context in zip(orders, grams, contexts, strict=True):
        p = _find(order.grams, order.discounted, gram, 0.0) + _find(order.contexts, order.backoff, context, 1.0) * p
    return np.log(np.maximum(p, 1e-12))


def cross_entropies(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log probability a character (rows by languages in sorted order) and the characters scored."""
    chars = Chars.of(texts)
    out = np.zeros((len(texts), len(model)))
    places = chars.places()
    if len(places) and model:
        code, unique = pd.factorize(hashes(chars.codes, places, ORDER))
        at = np.zeros(len(unique), dtype=np.int64)
        at[code[::-1]] = places[::-1]
        grams = [hashes(chars.codes, at, n) for n in range(1, ORDER + 1)]
        contexts = [np.zeros(len(at), np.uint64), *(hashes(chars.codes, at - 1, n) for n in range(1, ORDER))]
        begin = np.cumsum(chars.count) - chars.count
        full = chars.count > 0
        for k, lang in enumerate(sorted(model)):
            score = -_log_probability(*model[lang], grams, contexts)[code]
            out[full, k] = np.add.reduceat(score, begin[full]) / chars.count[full]
    return out, chars.count


def _judge(langs: list[str], limits: dict[str, float]):
    bounds = np.array([limits.get(x, np.inf) for x in langs])

    def rows(entropy: np.ndarray, count: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        if not langs:
            return [UNDETERMINED] * len(count), np.zeros(len(count)), np.zeros(len(count)), np.ones(len(count), bool)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(count)), best]
        odds = np.exp((lowest[:, None] - entropy) * np.minimum(count, EVIDENCE)[:, None])
        score = np.where(count > 0, 1 / odds.sum(axis=1), 0.0)
        names = [langs[b] if c else UNDETERMINED for b, c in zip(best, count, strict=True)]
        return names, score, np.where(count > 0, lowest, 0.0), (count == 0) | (lowest > bounds[best])

    return rows


def _predict(model: Model, limits: dict[str, float]):
    judge = _judge(sorted(model), limits)
    return lambda texts: judge(*cross_entropies(texts, model))


_JUDGED = ["lang_pred", "score", "cross_entropy", "rejected"]


def _judged(names: list[str], score: np.ndarray, entropy: np.ndarray, rejected: np.ndarray) -> list[pa.Array]:
    return [pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)]


def _row_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct highest-order grams of every row, with their number."""
    for batch in batches:
        for first, texts in _steps(batch, 1):
            chars = Chars.of(texts)
            places = chars.places()
            if not len(places):
                continue
            code, unique = pd.factorize(hashes(chars.codes, places, ORDER))
            row = np.repeat(np.arange(len(texts)), chars.count)
            pair, at, n = np.unique(row * len(unique) + code, return_index=True, return_counts=True)
            spelled = np.stack([chars.codes[places[at] - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(first + pair // len(unique))), pa.array([spelled[i : i + ORDER] for i in range(0, len(spelled), ORDER)]), pa.array(n, pa.int64())],
                names=["row", "gram", "n"],
            )


def _judged_by_tables(texts: DataFrame, model: Tables, limits: dict[str, float]) -> DataFrame:
    """row, lang_pred, score, cross_entropy and rejected of ``texts`` (row, text), by joins with the model's tables."""
    langs = sorted(model)
    grams = materialize(texts.select("row", "text").mapInArrow(Lean(_row_grams), "row long, gram string, n long"), "row-grams")
    every = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("lang"), F.lit(model.uniform[x]).alias("p")) for k, x in enumerate(langs)))
    p = grams.select("gram").distinct().select("gram", F.explode(every).alias("e")).select("gram", "e.k", "e.lang", "e.p")
    for n, (values, contexts) in enumerate(model.orders, 1):
        own = F.substring("gram", ORDER + 1 - n, n).alias("g")
        context = (F.substring("gram", ORDER + 1 - n, n - 1) if n > 1 else F.lit("")).alias("c")
        p = p.select("gram", "k", "lang", "p", own, context)
        p = p.join(values.withColumnRenamed("gram", "g"), ["lang", "g"], "left").join(contexts.withColumnRenamed("context", "c"), ["lang", "c"], "left")
        p = p.select("gram", "k", "lang", (F.coalesce("value", F.lit(0.0)) + F.coalesce("backoff", F.lit(1.0)) * F.col("p")).alias("p"))
    scores = materialize(p.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", F.ln(F.greatest("p", F.lit(1e-12))).alias("lp")))).alias("s")).select("gram", "s.lp"), "gram-scores")
    sums = grams.join(scores, "gram").select("row", "n", F.posexplode("lp").alias("k", "x")).groupBy("row", "k").agg(F.sum("n").alias("count"), F.sum(-F.col("x") * F.col("n")).alias("x"))
    of_row = sums.groupBy("row").agg(F.max("count").alias("count"), F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s")).select("row", "count", "s.x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(langs, limits)
        for batch in batches:
            count = batch.column(1).fill_null(0).to_numpy()
            entropy = np.array([x or [0.0] * len(langs) for x in batch.column(2).to_pylist()], dtype=float).reshape(len(count), len(langs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_judged(*judge(entropy / np.maximum(count, 1)[:, None], count))], names=["row", *_JUDGED])

    kinds = "row long, lang_pred string, score double, cross_entropy double, rejected boolean"
    return texts.select("row").join(of_row, "row", "left").select("row", "count", "x").mapInArrow(Lean(run), kinds)


def predict(docs: DataFrame, model: Model | Tables, limits: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected for every row.

    A null or empty text, or one without a letter, is ``und`` with score 0 and rejected; so is every
    text if the model is empty. Equal cross-entropies go to the first language by name. ``rejected`` is
    true if the lowest cross-entropy exceeds that language's limit. Rows with equal or null ids are
    judged one by one; other columns are ignored.
    """
    if isinstance(model, Tables):
        numbered = materialize(narrow(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "numbered")
        return numbered.select("row", "doc_id").join(_judged_by_tables(numbered, model, limits or {}), "row").select("doc_id", *_JUDGED)
    shared = docs.sparkSession.sparkContext.broadcast((model, limits or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _predict(*shared.value)
        for batch in batches:
            for first, texts in _steps(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *_judged(*rows(texts))], names=["doc_id", *_JUDGED])

    return narrow(docs, id_col, text_col).mapInArrow(Lean(run), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | Tables, limits: dict[str, float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text is not rejected; cases as for ``predict``."""
    if isinstance(model, Tables):
        own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
        numbered = materialize(docs.select(own, F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
        kept = _judged_by_tables(numbered.select("row", "text"), model, limits).filter("not rejected").select("row")
        return numbered.join(kept, "row", "left_semi").select("own.*")
    shared, at = docs.sparkSession.sparkContext.broadcast((model, limits)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _predict(*shared.value)
        for batch in batches:
            for first, texts in _steps(batch, at):
                yield batch.slice(first, len(texts)).filter(pa.array(~rows(texts)[3]))

    return docs.mapInArrow(Lean(run), docs.schema)


def calibrate(train: DataFrame, model: Model | Tables) -> dict[str, float]:
    """Limits of the cross-entropy by language, from all rows that the model was learned from.

    The limit lies five times as far above the median as the 99.5 % point, and at least one nat:
    texts that are merely short or unusual stay below it. A language that no row was assigned to has
    the limit of all rows together.
    """
    found = predict(train.filter("lang is not null and text is not null"), model).filter(f"lang_pred <> '{UNDETERMINED}' or score > 0")
    # Counted by rounded value, so that the quantiles take bounded memory.
    values = found.groupBy("lang_pred", F.round("cross_entropy", DIGITS).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    points = values.rollup("lang_pred").agg(F.expr("percentile(x, array(0.5, 0.995), n)").alias("q"), F.grouping("lang_pred").alias("all"))
    limits = {None if r["all"] else r["lang_pred"]: r["q"][0] + max(5 * (r["q"][1] - r["q"][0]), 1.0) for r in points.collect() if r["q"]}
    return {lang: limits.get(lang, limits[None]) for lang in model} if limits else {}


def remainder(doc_id: Column, k: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def held_out_prediction(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Fit on rows whose id hash does not fall in the held-out fold, predict all rows.

    Rows without id are not learned from and count as not held out.
    """
    train = docs.filter(remainder(F.col("doc_id"), folds) != held).select("doc_id", "text", "lang")
    model = fit(train)
    out = predict(docs, model, calibrate(train, model))
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")

"""Operator 7: toxicity by a weighted lexicon.

Text is folded (lower case, look-alike letters, digits and signs that stand for letters, no invisible
characters), and the entries of the lexicon, beginnings of words, are found by one Aho-Corasick pass.
Hits inside exception phrases do not count. The sum of weights and the sum per word go through a
logistic function. Lexicon and function are fitted on labelled rows, at most ``MAX_ROWS`` of them.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescope.llm.arrow import narrow, strings
from placescope.llm.language_id import remainder
from placescope.session import materialize

#: Labelled rows that are learned from at most: those with the smallest hash of the id.
MAX_ROWS = 20_000
#: Word beginnings that are looked at, by length; a whole word ends with the mark.
SHORTEST, LONGEST = 3, 14
#: An entry must stand in so many toxic training rows that rows drawn at random would all be toxic with
#: at most this probability.
CHANCE = 0.005
#: Log odds from which a candidate may enter the lexicon, and how often a row is to be covered.
LEAST_ODDS, COVER = 3.0, 4
THRESHOLD = 0.7

# Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pond scum", "sore loser")

# Characters that stand for a Latin letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t",
    "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
INVISIBLE = "­​‌‍⁠﻿"


class _Fold(dict):
    """What each code point becomes, filled as they occur: a space if it is no letter, mark or number."""

    def __missing__(self, c: int) -> int | str:
        self[c] = c if unicodedata.category(chr(c))[0] in "LMN" else " "
        return self[c]


def _fold_table() -> _Fold:
    table = _Fold({ord(c): v for c, v in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE})
    table.update({0xFF41 + k: chr(97 + k) for k in range(26)})  # full-width letters
    return table


FOLD = _fold_table()


def fold(text: str) -> str:
    """Folded text whose words are separated by spaces, with one at either end."""
    return f" {text.lower().translate(FOLD)} "


def beginnings(word: str) -> list[str]:
    return [" " + word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + ([f" {word} "] if len(word) >= SHORTEST else [])


def features(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(fold(text).split()):
        out.update(beginnings(word))
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """Number of toxic and of other texts with each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                part = batch.slice(first, 1_000)
                counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
                for text, toxic in zip(strings(part.column(0)), part.column(1).to_pylist(), strict=True):
                    counts[toxic == 1].update(features(text))
                names = list({*counts[0], *counts[1]})
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][f] for f in names], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _odds(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    return F.log((toxic + 0.5) / F.lit(all_toxic + 1.0)) - F.log((clean + 0.5) / F.lit(all_clean + 1.0))


def least_rows(toxic: int, clean: int) -> int:
    return max(2, math.ceil(math.log(CHANCE) / math.log(toxic / (toxic + clean))))


def choose(odds: dict[str, float], counts: dict[str, int], rows: list[list[str]], least: int) -> dict[str, float]:
    """Entries that cover the toxic rows ``COVER`` times over, the most useful first.

    No entry begins another one, so a word counts once. Of entries with equal counts along one word the
    longest is taken. Words that merely stand in the copies of one toxic text add nothing once its own
    rows are covered, and stay out.
    """
    holds: dict[str, list[int]] = {}
    for k, row in enumerate(rows):
        for f in row:
            holds.setdefault(f, []).append(k)
    covered, lexicon, barred = [0] * len(rows), {}, set()
    order = sorted(odds, key=lambda f: (-round(odds[f], 1) * counts[f], -len(f), f))
    for f in order:
        own = holds.get(f, [])
        if f in barred or any(f[:k] in lexicon for k in range(SHORTEST + 1, len(f))) or sum(covered[k] < COVER for k in own) < least:
            continue
        lexicon[f] = odds[f]
        barred.update(f[:k] for k in range(1, len(f)))
        for k in own:
            covered[k] += 1
    return lexicon


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    logistic: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def matcher(self):
        """Weight sum and weight sum per word of a text."""
        entries = {e: ("hit", w, len(e.strip())) for e, w in self.weights.items()}
        for phrase in self.exceptions:
            entries.setdefault(fold(phrase), ("except", 0.0, len(fold(phrase).strip())))
        machine = ahocorasick.Automaton()
        for entry, value in entries.items():
            machine.add_word(entry, (*value, entry.endswith(" ")))
        if entries:
            machine.make_automaton()

        def measure(text: str) -> tuple[float, float]:
            folded = " ".join(fold(text).split())
            if not folded or not entries:
                return 0.0, 0.0
            folded = f" {folded} "
            hits, safe = [], []
            for end, (kind, weight, size, closed) in machine.iter(folded):
                start = end - size + (not closed)
                (safe if kind == "except" else hits).append((start, start + size, weight))
            total = sum(w for a, b, w in hits if not any(s <= a < e for s, e, _ in safe))
            return math.log1p(total), math.log1p(100 * total / folded.count(" "))

        return measure

    def score(self, x: float, y: float) -> float:
        a, b, c = self.logistic
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _logistic(points: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(points)), points])
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
    return tuple(float(v) for v in w)


def _measured(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure, score = shared.value.matcher(), shared.value.score
        for batch in batches:
            points = [measure(t) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0] for p in points], pa.float64()), pa.array([p[1] for p in points], pa.float64()), pa.array([score(*p) for p in points], pa.float64())],
                names=["doc_id", "total", "density", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, total double, density double, score double")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn lexicon and score from the rows of ``labels`` (doc_id, toxic), at most ``max_rows`` of them.

    Null labels and ids are ignored. Without a toxic or without a clean row the lexicon is empty and
    every score is the share of toxic labels, or 0 without labels.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("label_id is not null and toxic is not null")
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    )
    chosen = materialize(chosen, "toxic-labels")
    d = narrow(docs, id_col, text_col)
    train = materialize(d.join(F.broadcast(chosen), d["doc_id"] == chosen["label_id"]).select("doc_id", "text", "toxic"), "toxic-train")  # at most max_rows ids
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, exceptions, (-30.0 if not toxic else 30.0, 0.0, 0.0))
    # What can be in the lexicon at all; the rows learned from are bounded, and with them its length.
    likely = _counted(train).filter(F.col("toxic") >= least_rows(toxic, clean)).withColumn("odds", _odds(F.col("toxic"), F.col("clean"), toxic, clean)).filter(F.col("odds") >= LEAST_ODDS)
    found = likely.collect()
    positive, odds = {r["feature"]: r["toxic"] for r in found}, {r["feature"]: r["odds"] for r in found}
    wanted = frozenset(odds)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features(t) & wanted) for t in strings(batch.column(0))], pa.list_(pa.string()))], names=["held"])

    rows = [r["held"] for r in train.filter("toxic = 1").select("text").mapInArrow(held, "held array<string>").collect()]  # toxic rows of the bounded sample
    lexicon = Lexicon(choose(odds, positive, rows, least_rows(toxic, clean)), exceptions)
    points = _measured(train, lexicon).select("doc_id", "total", "density").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("total", "density", "toxic").collect()
    x = np.array([(r["total"], r["density"]) for r in points])
    return Lexicon(lexicon.weights, exceptions, _logistic(x, np.array([r["toxic"] for r in points], dtype=float)))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every whole text.

    A null or empty text has no hits and gets the score of such texts. Rows with equal or null ids are
    scored one by one; other columns are ignored; an empty table gives no rows.
    """
    out = _measured(narrow(docs, id_col, text_col), lexicon)
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from labels outside the held-out fold of the id hash, score all rows."""
    lexicon = fit(docs, labels.filter(remainder(F.col("doc_id"), folds) != held))
    out = score(docs, lexicon)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")

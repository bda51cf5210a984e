r"""Operator 12: ranked lexical search by scanning documents with an automaton of all item terms.

Terms are runs of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`` after A-Z became lower case. Documents are
not indexed. An Aho-Corasick automaton of the terms of a block of items, each with a blank on both sides,
runs over the whole text, whose other bytes are blanks: it counts how often each term occurs, and the
outputs map to the items that have the term. One scan counts documents and terms, a second one scores.
A task keeps the best documents of each item only, so that what is shuffled grows with tasks and items.

A block of items is as large as its broadcast may be; with more items there are more blocks and scans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placescope.llm.arrow import narrow
from placescope.llm.ranking import ALL, Best
from placescope.session import materialize

TOP = 10
#: Weight of a document's length, in hundredths.
LENGTH_PERCENT = 90
#: Bytes of item terms, repeated for each item that has them, in one block; a longer item is a block of its own.
BLOCK_BYTES = 1 << 20
#: Cells of the score table and entries summed into it in one vectorised step about.
CELLS = 1 << 20
#: Scores below this are summed exactly as doubles.
_EXACT = 2**53

_OTHER = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Lower case, and a blank for every byte that is in no term.
_TERM_BYTES = bytes(32 if b in _OTHER else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)


def terms(text: str) -> list[str]:
    return normal(text).decode("utf-8", "surrogatepass").split(" ")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct terms of each item row and their size in bytes. Rows of one id make one item later on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(filter(None, terms(t.as_py() or "")))) for t in batch.column(1)]
            sizes = [sum(len(x.encode("utf-8", "surrogatepass")) for x in f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(sizes, pa.int64())], names=["item_id", "terms", "size"])

    return narrow(items, id_col, text_col).select(F.col("doc_id").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<string>, size long")


class Scanner:
    """The automaton of a block of items and what its outputs map to."""

    def __init__(self, block: dict[int | None, set[str]]) -> None:
        self.items = sorted(block, key=lambda i: (i is None, i or 0))
        self.terms = sorted(set().union(*block.values()))
        number = {t: k for k, t in enumerate(self.terms)}
        holders: list[list[int]] = [[] for _ in self.terms]
        for k, item in enumerate(self.items):
            for t in block[item]:
                holders[number[t]].append(k)
        #: Items of each term, one after the other, and where a term's begin.
        self.holders = np.array([k for h in holders for k in h], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int64)
        self.most_terms = max((len(t) for t in block.values()), default=0)
        self._automaton = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}  # built by each worker: it is several times its terms

    def counts(self, text: str) -> tuple[int, dict[int, int]]:
        """Number of terms of the text, and how often each term of the block occurs."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for k, t in enumerate(self.terms):
                self._automaton.add_word(f" {t} ", k)
            if self.terms:
                self._automaton.make_automaton()
        raw = normal(text)
        guarded = f" {raw.decode('utf-8', 'surrogatepass')} "
        # Neighbours share the blank between them: the automaton reports overlapping matches.
        return len(raw.split()), Counter(map(itemgetter(1), self._automaton.iter(guarded))) if self.terms else {}

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Score table of some documents by all items from their (document, term, tf) counts."""
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * lengths[doc]))
        holders = self.first[term + 1] - self.first[term]
        before = np.cumsum(holders) - holders
        item = self.holders[np.repeat(self.first[term] - before, holders) + np.arange(int(holders.sum()))]
        cell, part = np.repeat(doc, holders) * len(self.items) + item, np.repeat(part, holders)
        shape = (len(lengths), len(self.items))
        if self.most_terms * int(weights.max(initial=0)) * 1_000_000 < _EXACT:
            return np.bincount(cell, weights=part, minlength=shape[0] * shape[1]).astype(np.int64).reshape(shape)
        out = np.zeros(shape[0] * shape[1], np.int64)
        np.add.at(out, cell, part)
        return out.reshape(shape)


def _statistics(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task the documents with each term; as terms -1 and -2 the documents and terms of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, found = shared.value, Counter()
        for batch in batches:
            for text in batch.column(1):
                n, tf = scanner.counts(text.as_py() or "")
                if n:
                    found[-1] += 1
                    found[-2] += n
                    found.update(tf.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return run


def _ranked(shared, weights: np.ndarray, documents: int, total: int, keep: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best documents of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = shared.value
        best = Best(len(scanner.items), keep)
        items = np.arange(len(scanner.items))
        ids: list[int] = []
        lengths: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cells = 0

        def settled() -> None:
            doc, term, tf = (np.concatenate(c) for c in zip(*parts, strict=True))
            score = scanner.scores(doc, term, tf, np.array(lengths, np.int64), weights).T
            own = np.array(ids, np.int64)
            who, at = best.improving(items, score, own, score > 0)
            best.add(who, score[who, at], own[at])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = scanner.counts(text.as_py() or "")
                if not found:
                    continue
                term = np.fromiter(found.keys(), np.int64, len(found))
                parts.append((np.full(len(found), len(ids)), term, np.fromiter(found.values(), np.int64, len(found))))
                ids.append(ALL if i is None else i)
                lengths.append(100 - percent + percent * n * documents // total)
                cells += len(items) + int((scanner.first[term + 1] - scanner.first[term]).sum())
                if cells >= CELLS:
                    settled()
                    ids, lengths, parts, cells = [], [], [], 0
        if parts:
            settled()
        item = pa.array([scanner.items[k] for k in best.search], pa.int64())
        yield pa.RecordBatch.from_arrays([item, pa.array([None if i == ALL else i for i in best.id.tolist()], pa.int64()), pa.array(best.score)], names=["item_id", "doc_id", "score"])

    return run


def _item_blocks(items: DataFrame, most: int) -> Iterator[dict[int | None, set[str]]]:
    """Blocks of items on the driver, one at a time; each of at most ``most`` bytes of terms or of one item."""
    size = items.agg(F.sum("size").alias("s")).first()["s"] or 0
    blocks = max(1, math.ceil(size / most))
    number = lambda: F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    while items.groupBy(number().alias("block")).agg(F.sum("size").alias("s"), F.min("item_id").alias("a"), F.max("item_id").alias("b")).filter((F.col("s") > most) & (F.col("a") < F.col("b"))).first():
        blocks *= 2
    for k in range(blocks):
        block: dict[int | None, set[str]] = {}
        for row in items.filter(number() == k).select("item_id", "terms").collect():
            block.setdefault(row["item_id"], set()).update(row["terms"])
        if any(block.values()):
            yield block


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, percent: int = LENGTH_PERCENT, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``top`` documents with a score above 0.

    A null or empty text has no terms: such a document counts for nothing, such an item gives no rows.
    Rows that share a document id are documents of their own; equal scores go by ascending id, null ids
    last. Rows that share an item id, also a null one, are one item with the terms of all. Empty tables
    give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = narrow(docs, id_col, text_col)
    known = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    best = None
    for block in _item_blocks(known, block_bytes):
        scanner = Scanner(block)
        shared = spark.sparkContext.broadcast(scanner)
        # One row per term of the block, whose size is bounded, and the two totals.
        figures = {r["term"]: r["n"] for r in texts.mapInArrow(_statistics(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents, total = figures.get(-1, 0), figures.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * figures.get(k, 0) + 1))) for k in range(len(scanner.terms))], np.int64)
        few = materialize(texts.mapInArrow(_ranked(shared, weights, documents, total, top, percent), "item_id long, doc_id long, score long"), "best-documents")
        best = few if best is None else best.unionByName(few)
    if best is None:
        best = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, docs),
s AS (
  SELECT i.item_id, d.r, d.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * docs) // total))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

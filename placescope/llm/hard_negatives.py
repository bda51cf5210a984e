"""Operator 11: hard negatives by exact inner-product search with coordinate pruning.

A row's components become whole numbers, floor(``SCALE`` * x). Rows are dealt to shares by their id,
ordered by length and packed into blocks of similar length; a block holds for each coordinate the list of
its rows sorted by that coordinate of the unit vector. An anchor that seeks products of at least t in a
block whose longest vector is l needs a cosine of at least t / (|anchor| * l). That bounds each coordinate
of a match from both sides, most narrowly where the anchor's own coordinate is large: on these focus
coordinates the ranges of the sorted lists are intersected, and only what is left is multiplied out.

Anchors travel in blocks as well and meet the blocks of rows share by share. First an anchor's
positives are sought among the rows of its label, the running fifth product being the threshold; then
its negatives among all others, each positive bounding the products from both sides. A share gives each
search its few best rows only, which one more ranking settles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescope.llm.ranking import ALL, Best
from placescope.session import materialize

SCALE = 256
ANCHOR_STEP = 50
POSITIVES = 5
NEGATIVES = 3
#: Negatives have from LOW to HIGH per cent of the product of their positive.
LOW, HIGH = 50, 95
#: Rows of a block of vectors and of a block of anchors.
BLOCK_ROWS, BLOCK_ANCHORS = 1024, 512
#: Anchors that one task packs into blocks about.
PACK_ANCHORS = 4096
#: A block ends where its rows are shorter than this part of its longest one.
BUCKET = 0.9
#: Coordinates of an anchor whose ranges are intersected.
FOCUS = 4
#: Rows that one share holds about, and the number of shares at least.
SHARE_ROWS, LEAST_SHARES = 1 << 20, 24
#: Products of greater vectors may leave 64 bits: such rows are multiplied as Python numbers.
_EXACT_FLOAT, _EXACT_LONG = 2.0**53, 2.0**63

BLOCK_SCHEMA = "key long, share int, n int, dim int, longest double, size double, ids binary, labels binary, vectors binary, lists binary"
_BLOCK_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


def prepared(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows that take part: id, label and whole-number components, other columns left out.

    Rows with a null id, label or vector or with a null or non-finite component take no part. A vector
    that is shorter than another counts as padded with zeros; an empty one has the product 0 with all.
    """
    x = F.col(vector_col).cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0**52)))
    rows = table.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).filter(usable)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda v: F.floor(F.lit(SCALE) * v).cast("long")).alias("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch as rows of ``dim`` columns, shorter ones padded with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def _blocks(most: int, bucket: float, listed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs rows that arrive by key and share, longest first; a block ends with its length bucket."""

    def packed(key: int, share: int, rows: list[tuple[int, int, np.ndarray, float]]) -> list[tuple]:
        dim = max(len(r[2]) for r in rows)
        vectors = np.zeros((len(rows), dim), np.int64)
        for k, r in enumerate(rows):
            vectors[k, : len(r[2])] = r[2]
        lists = b""
        if listed:
            unit = vectors / np.maximum(_lengths(vectors), 1e-300)[:, None]
            lists = np.argsort(unit, axis=0, kind="stable").T.astype("<u2").tobytes()
        greatest = float(np.abs(vectors).max(initial=0))
        kind = "<i2" if greatest < 2**15 else "<i8"
        return [key, share, len(rows), dim, rows[0][3], greatest, np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "<i8").tobytes(), vectors.astype(kind).tobytes(), lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(packed(*at, held), kinds, strict=True)], names=_BLOCK_NAMES)

        at, held = (0, 0), []
        for batch in batches:
            column = batch.column("vector")
            offsets, flat = np.asarray(column.offsets), np.asarray(column.flatten())
            offsets = offsets - offsets[0] if len(offsets) else offsets
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "share", "id", "label", "length")), strict=True)
            for k, (key, share, i, label, length) in enumerate(rows):
                if held and (at != (key, share) or len(held) >= most or length < bucket * held[0][3]):
                    yield emitted()
                    held = []
                at = (key, share)
                held.append((i, label, flat[offsets[k] : offsets[k + 1]], length))
        if held:
            yield emitted()

    return run


def blocks(rows: DataFrame, key: Column, share: Column, most: int, bucket: float, listed: bool) -> DataFrame:
    """Blocks of the rows of each (key, share), in order of falling length."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    dealt = rows.select(key.alias("key"), share.cast("int").alias("share"), "id", "label", "vector", length.alias("length"))
    return dealt.repartition("key", "share").sortWithinPartitions("key", "share", F.desc("length"), "id").mapInArrow(_blocks(most, bucket, listed), BLOCK_SCHEMA)


@dataclass
class Block:
    """A block as a task uses it."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    longest: float
    size: float
    order: np.ndarray | None = None
    values: np.ndarray | None = None

    @classmethod
    def of(cls, row: dict, prefix: str) -> Block:
        n, dim, size = row[f"{prefix}n"], row[f"{prefix}dim"], row[f"{prefix}size"]
        vectors = np.frombuffer(row[f"{prefix}vectors"], "<i2" if size < 2**15 else "<i8").reshape(n, dim)
        out = cls(np.frombuffer(row[f"{prefix}ids"], "<i8"), np.frombuffer(row[f"{prefix}labels"], "<i8"), vectors, row[f"{prefix}longest"], size)
        if row.get(f"{prefix}lists") is not None:
            out.order = np.frombuffer(row[f"{prefix}lists"], "<u2").reshape(dim, n)
            unit = vectors / np.maximum(_lengths(vectors), 1e-300)[:, None]
            out.values = np.take_along_axis(unit.T, out.order.astype(np.int64), axis=1)
        return out


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``; ``bound`` is that of one of them."""
    if bound < _EXACT_FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < _EXACT_LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[max(min(v, 2**63 - 1), -(2**63)) for v in row] for row in exact], np.int64).reshape(len(a), len(b))


def ranges(unit: np.ndarray, coordinate: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a coordinate of a unit vector whose cosine with the anchor is at least ``cosine``.

    ``unit`` are the anchor's values there. A little more room than the formula has covers rounding;
    without a positive cosine to reach, every value is possible.
    """
    q, t = unit[np.arange(len(unit)), coordinate], np.clip(cosine, 0.0, 1.0)
    reach = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - q * q)))
    low = np.where(q <= -t, -1.0, q * t - reach)
    high = np.where(q >= t, 1.0, q * t + reach)
    free = cosine <= 0
    return np.where(free, -2.0, low - 1e-9), np.where(free, 2.0, high + 1e-9)


def candidates(anchors: Block, unit: np.ndarray, focus: np.ndarray, least: np.ndarray, rows: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of anchors with the rows that are left for them; an anchor stands in at most one group.

    ``least`` are the products that the anchors seek at least.
    """
    n = len(rows.ids)
    reach = _lengths(anchors.vectors) * rows.longest
    cosine = np.where(reach > 0, least / np.maximum(reach, 1e-300), np.where(least > 0, 2.0, -1.0))
    alive = cosine <= 1 + 1e-9
    first, end = np.zeros((focus.shape[1], len(alive)), np.int64), np.full((focus.shape[1], len(alive)), n, np.int64)
    bounds = []
    for j in range(focus.shape[1]):
        low, high = ranges(unit, focus[:, j], cosine)
        bounds.append((low, high))
        for f in np.unique(focus[:, j]):
            who = np.flatnonzero((focus[:, j] == f) & alive & (f < len(rows.values)))
            first[j, who] = np.searchsorted(rows.values[f], low[who], side="left") if f < len(rows.values) else 0
            end[j, who] = np.searchsorted(rows.values[f], high[who], side="right") if f < len(rows.values) else n
    left = end - first
    fewest = left.min(axis=0) if len(left) else np.full(len(alive), n)
    whole = np.flatnonzero(alive & (fewest == n))
    if len(whole):
        yield whole, np.arange(n)
    for a in np.flatnonzero(alive & (fewest > 0) & (fewest < n)):
        seen = np.zeros(n, np.int8)
        lists = 0
        for j in range(focus.shape[1]):
            if left[j, a] < n:
                seen[rows.order[focus[a, j], first[j, a] : end[j, a]]] += 1
                lists += 1
        some = np.flatnonzero(seen == lists)
        if len(some):
            yield np.array([a]), some


def _focus(anchors: Block, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the anchors and the coordinates on which they are greatest."""
    unit = anchors.vectors / np.maximum(_lengths(anchors.vectors), 1e-300)[:, None]
    most = min(FOCUS, unit.shape[1])
    return unit, np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :most]


def _met(anchors: DataFrame, rows: DataFrame, on: list[str], shares: Column) -> DataFrame:
    """Each block of anchors with every block of rows of the same key in each of its shares, share by share."""
    a = anchors.withColumn("share", F.explode(F.sequence(F.lit(0), (shares - 1).cast("int"))))
    a = a.select(*on, *(F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in on))
    b = rows.select(*on, *(F.col(c).alias(f"b_{c}") for c in rows.columns if c not in on))
    return a.hint("merge").join(b.hint("merge"), on)


def _bound(a: Block, b: Block) -> float:
    return max(a.size, 1.0) * max(b.size, 1.0) * max(1, min(a.vectors.shape[1], b.vectors.shape[1]))


def _aligned(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    dim = min(a.vectors.shape[1], b.vectors.shape[1])
    return a.vectors[:, :dim], b.vectors[:, :dim]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Block, dict, Block]]:
    """Pairs of an anchor block and a row block; a block that follows itself is unpacked once."""
    a_key = b_key = None
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            row = {c: batch.column(j)[k].as_py() for j, c in enumerate(names) if c not in ("b_vectors", "b_lists", "b_ids", "b_labels")}
            now = (row["a_ids"], row["a_labels"])
            if now != a_key:
                a_key, a = now, Block.of(row, "a_")
            lead = batch.column("b_ids")[k].as_py(), batch.column("b_labels")[k].as_py()
            if lead != b_key:
                row |= {c: batch.column(c)[k].as_py() for c in ("b_vectors", "b_lists")} | dict(zip(("b_ids", "b_labels"), lead, strict=True))
                b_key, b = lead, Block.of(row, "b_")
            yield now, a, row, b


def _positives(keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, block, unit, focus = None, None, None, None, None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(block.ids[best.search]), pa.array(block.labels[best.search]), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "label", "id", "score"])

        for key, a, _, b in _units(batches):
            if key != held:
                if best is not None and len(best.id):
                    yield found()
                held, block, best = key, a, Best(len(a.ids), keep)
                unit, focus = _focus(a, b.vectors.shape[1])
            for who, some in candidates(a, unit, focus, best.least.astype(np.float64), b):
                x, y = _aligned(a, b)
                score = products(x[who], y[some], _bound(a, b))
                fits = b.ids[some][None, :] != a.ids[who][:, None]
                i, j = best.improving(who, score, b.ids[some], fits)
                best.add(who[i], score[i, j], b.ids[some[j]])
        if best is not None and len(best.id):
            yield found()

    return run


def positives(anchors: DataFrame, rows: DataFrame, shares: Column, keep: int = POSITIVES) -> DataFrame:
    """anchor_id, label, id, score of each anchor's best other rows of its label; blocks of both are by label."""
    few = _met(anchors, rows, ["key", "share"], shares).mapInArrow(_positives(keep), "anchor_id long, label long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    return few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def _negatives(keep: int, each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, block, unit, focus, floor, ceiling = (None,) * 7

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(block.ids[best.search // each]), pa.array((best.search % each + 1).astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "place", "id", "score"]
            )

        for key, a, row, b in _units(batches):
            if key != held:
                if best is not None and len(best.id):
                    yield found()
                held, block, best = key, a, Best(len(a.ids) * each, keep)
                unit, focus = _focus(a, b.vectors.shape[1])
                floor = np.frombuffer(row["a_floor"], "<i8").reshape(-1, each)
                ceiling = np.frombuffer(row["a_ceiling"], "<i8").reshape(-1, each)
            least = np.maximum(best.least.reshape(-1, each), floor)
            for who, some in candidates(a, unit, focus, np.where(floor <= ceiling, least, ALL).min(axis=1).astype(np.float64), b):
                x, y = _aligned(a, b)
                score = products(x[who], y[some], _bound(a, b))
                fits = b.labels[some][None, :] != a.labels[who][:, None]
                for p in range(each):
                    inside = fits & (score >= floor[who, p][:, None]) & (score <= ceiling[who, p][:, None])
                    if not inside.any():
                        continue
                    i, j = best.improving(who * each + p, score, b.ids[some], inside)
                    best.add(who[i] * each + p, score[i, j], b.ids[some[j]])
        if best is not None and len(best.id):
            yield found()

    return run


def _bounded(low: int, high: int, each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives blocks of anchors the least and greatest product of the negatives of each positive, none as an empty range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, ceilings = [], []
            for k in range(batch.num_rows):
                scores = dict(zip(batch.column("owners")[k].as_py(), batch.column("scores")[k].as_py(), strict=True))
                ids = np.frombuffer(batch.column("ids")[k].as_py(), "<i8").tolist()
                rows = [(scores.get(i, []) + [None] * each)[:each] for i in ids]
                floors.append(np.array([[1 if s is None else -(-low * s // 100) for s in r] for r in rows], "<i8").tobytes())
                ceilings.append(np.array([[0 if s is None else high * s // 100 for s in r] for r in rows], "<i8").tobytes())
            kept = batch.drop_columns(["owners", "scores"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(floors, pa.binary()), pa.array(ceilings, pa.binary())], names=[*kept.schema.names, "floor", "ceiling"])

    return run


def mine(
    table: DataFrame,
    is_anchor: Column | None = None,
    keep_positives: int = POSITIVES,
    keep_negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive.

    ``is_anchor`` and ``label`` are columns over ``id`` and ``label`` of the rows that take part (see
    ``prepared``). Higher products come first, ties by the smaller id. Rows with a null id, label or
    vector and rows with a null or non-finite component (or one of 2**52 and more) take no part. Rows that
    share an id are not each other's positives; of rows that repeat with their id any one is named, and an
    id's rows that are anchors count as one. A product beyond 64 bits counts as the nearest 64-bit number.
    A positive without a negative in range gives no row, as do an empty table and a table without anchors;
    other columns are ignored.
    """
    spark = table.sparkSession
    rows = prepared(table, id_col, vector_col, label_col)
    rows = materialize(rows.withColumn("label", F.col("label") if label is None else label.cast("long")), "vectors")
    chosen = F.col("id") % ANCHOR_STEP == 0 if is_anchor is None else is_anchor
    per_label = materialize(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(chosen).alias("anchors")), "label-counts")
    sums = per_label.agg(F.sum("n").alias("n"), F.sum("anchors").alias("anchors")).first()
    total, packs_of_all = sums["n"] or 0, math.ceil((sums["anchors"] or 0) / PACK_ANCHORS) or 1
    shares = max(LEAST_SHARES, math.ceil(total / SHARE_ROWS))
    # A label has shares of its own, as many as its part of the rows.
    label_shares = per_label.select("label", F.greatest(F.lit(1), F.ceil(F.col("anchors") / F.lit(PACK_ANCHORS))).alias("packs"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(shares) / F.lit(max(total, 1)))).alias("label_shares"))
    anchors = rows.filter(chosen).dropDuplicates(["id"])
    salt = F.xxhash64("id")

    by_label = rows.join(label_shares, "label")
    row_blocks = blocks(by_label, F.col("label"), F.pmod(salt, F.col("label_shares")), BLOCK_ROWS, BUCKET, True)
    own = anchors.join(label_shares, "label")
    own_blocks = blocks(own, F.col("label"), F.pmod(salt, F.col("packs")), BLOCK_ANCHORS, 0.0, False).drop("share", "lists")
    own_blocks = own_blocks.join(label_shares.select(F.col("label").alias("key"), "label_shares"), "key")
    found = materialize(positives(own_blocks, row_blocks, F.col("label_shares"), keep_positives).drop("label"), "positives")

    whole = F.lit(0).cast("long")
    all_blocks = blocks(rows, whole, F.pmod(salt, F.lit(shares)), BLOCK_ROWS, BUCKET, True)
    seekers = anchors.join(found.filter("score >= 0").select(F.col("anchor_id").alias("id")).distinct(), "id", "left_semi")
    packs = materialize(blocks(seekers.select("id", "label", "vector"), whole, F.pmod(salt, F.lit(packs_of_all)), BLOCK_ANCHORS, 0.0, False).drop("lists").withColumn("pack", F.monotonically_increasing_id()), "anchor-blocks")
    bounded = _with_bounds(packs, found, low, high, keep_positives).drop("share", "pack")
    few = _met(bounded, all_blocks, ["key", "share"], F.lit(shares)).mapInArrow(_negatives(keep_negatives, keep_positives), "anchor_id long, place int, id long, score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    ranked = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep_negatives)
    named = found.select("anchor_id", F.col("place").cast("int").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(b.as_py(), "<i8") for b in batch.column("ids")]
        pack = np.repeat(np.asarray(batch.column("pack")), [len(i) for i in ids])
        yield pa.RecordBatch.from_arrays([pa.array(pack, pa.int64()), pa.array(np.concatenate(ids) if ids else [], pa.int64())], names=["pack", "anchor_id"])


def _with_bounds(packs: DataFrame, found: DataFrame, low: int, high: int, each: int) -> DataFrame:
    """Blocks of anchors with the bounds of their positives; a block's list is as long as the block."""
    scores = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("s")).select("anchor_id", F.col("s.score").alias("score"))
    of_pack = packs.select("pack", "ids").mapInArrow(_members, "pack long, anchor_id long").join(scores, "anchor_id").groupBy("pack")
    lists = of_pack.agg(F.collect_list("anchor_id").alias("owners"), F.collect_list("score").alias("scores"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packs.schema.fields) + ", floor binary, ceiling binary"
    return packs.join(lists, "pack").select(*packs.columns, "owners", "scores").mapInArrow(_bounded(low, high, each), schema)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score
  FROM c a JOIN c b ON a.i = b.i AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""

r"""Operator 2: MinHash near-dedup with tensored banding.

Two collections of ``HALVES`` half keys of ``ROWS`` minimum hashes each are computed per document; a
table (i, j) has as key half key i of the first and j of the second, so HALVES**2 tables of 2 * ROWS
hashes cost only 2 * HALVES * ROWS minima. At the similarity of 0.75 a pair shares a table with
probability (1 - (1 - 0.75**ROWS)**HALVES)**2, which is 0.9996.

Documents with equal shingle sets are one class. Classes that share no half key of either collection
drop out before any table key is made. Links are confirmed on the full shingle sets. First each class is
held against one central class of its tables on a diagonal, which joins most groups without pairing
their members. What is left are pairs of classes of different components in a common table: all tables
(i, j) of one i are searched together, by meeting on half key i and comparing the second collection.
There a pair whose minima agree so rarely that it lies six standard deviations below the threshold is
not confirmed, so that a passage common to very many texts does not make all pairs of them; at exactly
0.75 that passes over one pair in 300,000,000, far fewer than the tables do. Where many classes that are
linked with nothing meet a large group, sets of up to 512 shingles are compared in the join itself. Before
all that, a bitmap of each set bounds what a pair can have in common; the bound never falls below the truth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescope.llm.arrow import Lean, blocks, buffers, narrow
from placescope.llm.bytehash import digests, mix, sums
from placescope.llm.components import components
from placescope.session import materialize

SHINGLE = 5
PERCENT = 75
ROWS, HALVES = 5, 32
#: Diagonals of tables that are searched for one central class each.
ROUNDS = 3
#: Minima a signature keeps four bits of each, in words of 64 bits.
MINIMA = 2 * HALVES * ROWS
SIGNATURE_WORDS = MINIMA // 16
#: Equal four-bit entries a pair must have to be confirmed. Two minima are equal with the probability of
#: the similarity, else their four bits with 1/16; six standard deviations below that at 0.75.
_P = PERCENT / 100 + (1 - PERCENT / 100) / 16
LEAST_EQUAL = math.floor(MINIMA * _P - 6 * math.sqrt(MINIMA * _P * (1 - _P)))

#: Words of the bitmap of a set, a power of two.
BITMAP_WORDS = 32
BITMAP_SHIFT = np.uint64(64 - (64 * BITMAP_WORDS).bit_length() + 1)

#: Shingles of a set that may travel whole, and strays of a bucket from which they do.
SHORT_SET, FEW_STRAYS = 512, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEPS = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_MULTIPLIERS = mix(np.arange(1, 1 + 2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALTS = mix(np.arange(7001, 7001 + 2 * HALVES, dtype=np.uint64))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block and the row it stands in; ``bounds`` are the rows' byte offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, blank = _LOWER[data], _BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = ~blank & edge[:n]
    start[1:] |= ~blank[1:] & blank[:-1]
    end = ~blank & edge[1:]
    end[:-1] |= ~blank[:-1] & blank[1:]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    return digests(sums(low), first, last), np.searchsorted(bounds, first, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a text buffer, in row order."""
    for first, end in blocks(offsets):
        bounds = offsets[first : end + 1] - offsets[first]
        words, row = word_hashes(data[offsets[first] : offsets[end]], bounds)
        per_row = np.bincount(row, minlength=end - first)
        at = np.cumsum(per_row) - per_row
        whole = np.zeros(0, np.uint64)
        if len(words) >= SHINGLE:
            n = len(words) - SHINGLE + 1
            whole = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                whole += words[k : k + n] * _STEPS[k]
            whole = mix(whole)
        for begin, count in zip(at.tolist(), per_row.tolist(), strict=True):
            if count >= SHINGLE:
                yield np.unique(whole[begin : begin + count - SHINGLE + 1])
            elif count:
                value = mix(np.array([count], dtype=np.uint64))
                for w in words[begin : begin + count]:
                    value = mix(value * _STEPS[0] + w)
                yield value
            else:
                yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    n = np.uint64(len(shingles))
    return tuple(int((mix(shingles ^ salt).sum(dtype=np.uint64) + n).astype(np.int64)) for salt in _SALTS[:2])


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, ~np.uint64(0))
    for first in range(0, len(shingles), 1024):
        least = np.minimum(least, np.multiply.outer(_MULTIPLIERS, shingles[first : first + 1024]).min(axis=1))
    return least


def half_keys(least: np.ndarray) -> np.ndarray:
    """The half keys of both collections, one after the other."""
    keys = _SALTS.copy()
    for r in range(ROWS):
        keys = mix(keys * _STEPS[1] + least[r::ROWS])
    return keys.astype(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen to a word."""
    four = (mix(least) & np.uint64(15)).reshape(SIGNATURE_WORDS, 16)
    return np.bitwise_or.reduce(four << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).astype(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for the upper bits of every shingle hash, 64 to a word."""
    bits = np.zeros(64 * BITMAP_WORDS, dtype=np.uint8)
    bits[(shingles >> BITMAP_SHIFT).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        for first in range(0, batch.num_rows, 1_000):
            part, out = batch.slice(first, 1_000), []
            for shingles in shingle_sets(*buffers(part.column(1))):
                least = minima(shingles)
                out.append((len(shingles), *set_key(shingles), half_keys(least), signature(least)) if len(shingles) else (0, None, None, None, None))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds, strict=True))], names=["doc_id", "n_shingles", "k1", "k2", "halves", "signature"]
            )


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as zstd frames: it moves through shuffles at about a third of its size."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = buffers(batch.column(batch.num_columns - 1))
        view = memoryview(data)
        frames = pa.array([packer.compress(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], frames], names=[*batch.schema.names[:-1], "z"])


def _sets_of(frames: list[bytes]) -> list[np.ndarray]:
    unpacker = zstandard.ZstdDecompressor()
    raw = [unpacker.decompress(f) for f in frames]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return list(shingle_sets(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets))


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the shingle set that they were chosen for (ids may repeat with other texts).

    They get its bitmap and the number of shingles by which it is larger than the bits set in that.
    """
    for batch in batches:
        if batch.num_rows:
            sets = _sets_of(batch.column("z").to_pylist())
            want = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)
            keep = [len(s) > 0 and set_key(s) == k for s, k in zip(sets, want, strict=True)]
            kept = [(bitmap(s), len(s)) for s, k in zip(sets, keep, strict=True) if k]
            bits = pa.array([b for b, _ in kept], pa.list_(pa.int64()))
            fell = pa.array([n - int(np.bitwise_count(b.view(np.uint64)).sum()) for b, n in kept], pa.int64())
            node, z = batch.select(["node", "z"]).filter(pa.array(keep, pa.bool_())).columns
            yield pa.RecordBatch.from_arrays([node, z, bits, fell], names=["node", "z", "bits", "fell"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose shingle sets are similar enough; a class that occurs in many pairs of a step is hashed once."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            frames = dict(zip([*a, *b], [*part.column("za").to_pylist(), *part.column("zb").to_pylist()], strict=True))
            sets = dict(zip(frames, _sets_of(list(frames.values())), strict=True))
            keep = []
            for x, y in zip(a, b, strict=True):
                s, t = sets[x], sets[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(Lean(_confirmed), "a long, b long"), "near-links")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, key, half keys and signature of every row's shingle set; nulls for an empty set."""
    return narrow(docs, id_col, text_col).mapInArrow(Lean(_signatures), "doc_id long, n_shingles long, k1 long, k2 long, halves array<long>, signature array<long>")


def _stars(nodes: DataFrame, step: int) -> DataFrame:
    """Each class with the class of another component that shares most half keys, of its tables (i, i + step)."""
    other = lambda i: HALVES + (i + step) % HALVES
    both = F.filter("u", lambda i: F.array_contains("v", other(i)))
    keys = F.transform(both, lambda i: F.xxhash64(i, F.get("halves", i), F.get("halves", other(i))))
    tables = nodes.select("node", "label", "weight", F.explode(keys).alias("key"))
    central = tables.groupBy("key").agg(F.max(F.struct("weight", "node", "label")).alias("centre"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", "centre")
    met = tables.join(central, "key").filter("label <> centre.label")
    return met.groupBy("node").agg(F.max("centre").alias("centre")).select(F.col("node").alias("a"), F.col("centre.node").alias("b"))


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of at most ``SHORT_SET`` shingles as distinct 16-bit hashes, with the number that fell together."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            whole = _sets_of(part.column("z").to_pylist()) if part.num_rows else []
            short = [np.unique((s >> np.uint64(48)).astype(np.uint16).view(np.int16)) if len(s) <= SHORT_SET else None for s in whole]
            lost = [None if t is None else len(s) - len(t) for s, t in zip(whole, short, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(short, pa.list_(pa.int16())), pa.array(lost, pa.int32())], names=["node", "short", "lost"])


def _across(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share a table and may be similar enough.

    In a bucket of the first collection only classes outside its largest component meet the others, and
    a pair counts in the first bucket that it has in common. Half keys travel as their upper 32 bits.
    Where more than ``FEW_STRAYS`` classes meet the others, the sets travel as well, as 16-bit hashes. At
    most as many common shingles can be missing from the common hashes as fell together in either set,
    so that the join decides by an upper bound of the similarity, not by the estimate. The common bits of two
    bitmaps bound it in the same way and come first, as they cost little: a large group and its strays
    meet in a number of pairs that grows with the square of the group.

    The words are columns of their own. Thereby the join has more fields than ``spark.sql.codegen.maxFields``
    and its condition is compiled alone, in small methods; as a part of a whole stage it was one method of more
    than the 8,000 bytes that the JVM compiles, and every pair went through the interpreter.
    """
    halves = lambda: F.explode(F.transform("u", lambda i: F.get("halves", i))).alias("h")
    tally = nodes.select("label", halves()).groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = tally.groupBy("h").agg(F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("all"))
    mixed = materialize(largest.filter("kinds > 1").select("h", F.col("most.label").alias("main"), (F.col("all") - F.col("most.c") > FEW_STRAYS).alias("hot")), "mixed-halves")
    hot = nodes.select("node", halves()).join(mixed.filter("hot").select("h"), "h").groupBy("node").agg(F.collect_list("h").alias("hot"))
    short = texts.join(hot.select("node"), "node").mapInArrow(Lean(_short_sets), "node long, short array<short>, lost int")
    with_sets = materialize(hot.join(short, "node", "left"), "short-sets")

    words, maps = [f"s{k}" for k in range(SIGNATURE_WORDS)], [f"m{k}" for k in range(BITMAP_WORDS)]
    bits = texts.groupBy("node").agg(F.first("bits").alias("bits"), F.first("fell").alias("fell"))
    upper = lambda places: F.transform(places, lambda i: F.shiftright(F.get("halves", i), 32).cast("int"))
    slim = nodes.join(bits, "node").select("node", "n", "label", "halves", "fell", "u", upper(F.sort_array("u")).alias("us"), upper("v").alias("vs"), *(F.get(of, F.lit(k)).alias(w) for of, ws in (("signature", words), ("bits", maps)) for k, w in enumerate(ws)))
    wide = slim.join(with_sets, "node", "left").select("node", "n", "label", "us", "vs", *words, *maps, "fell", "hot", "short", "lost", halves())
    rows = wide.withColumn("short", F.when(F.array_contains("hot", F.col("h")), F.col("short"))).drop("hot")
    met = rows.join(mixed.select("h", "main"), "h")
    carried = {"n": "n", "us": "u", "vs": "v", "short": "short", "lost": "lost", "fell": "fell"}
    x = met.filter("label <> main").select("h", F.col("node").alias("a"), F.col("label").alias("la"), *(F.col(c).alias(f"{t}a") for c, t in carried.items()), *(F.col(w).alias(f"a{w}") for w in [*words, *maps]))
    y = met.select("h", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("main").alias("mb"), *(F.col(c).alias(f"{t}b") for c, t in carried.items()), *(F.col(w).alias(f"b{w}") for w in [*words, *maps]))
    unequal, bits_in_both = F.lit(0), F.lit(0)
    for w in words:
        d = F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        unequal = unequal + F.bit_count(d)
    for w in maps:
        bits_in_both = bits_in_both + F.bit_count(F.col(f"a{w}").bitwiseAND(F.col(f"b{w}")))
    # I common of a + b - I: 100 * I >= P * (a + b - I), with I at most what the hashes show and what fell together.
    similar = lambda common: (100 + PERCENT) * common >= PERCENT * (F.col("na") + F.col("nb"))
    # Two classes outside the largest component meet twice; one of the meetings counts.
    fits = F.expr(f"la <> lb and (lb = mb or a > b) and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    fits = fits & similar(bits_in_both + F.least("fella", "fellb"))
    decided = F.col("shorta").isNotNull() & F.col("shortb").isNotNull()
    fits = fits & (decided | (MINIMA - unequal >= LEAST_EQUAL))
    fits = fits & F.arrays_overlap("va", "vb") & (F.get(F.array_intersect("ua", "ub"), F.lit(0)) == F.shiftright(x["h"], 32).cast("int"))
    fits = fits & (~decided | similar(F.size(F.array_intersect("shorta", "shortb")) + F.least("losta", "lostb")))
    return x.join(y, (x["h"] == y["h"]) & fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the class key of every row.

    Rows without words (null, empty or blank text) have no shingles and are linked with nothing; their
    component is their own id. Rows with equal sets are linked, also if they share an id; a null id is
    never the smallest one of a component unless there is no other. An empty table gives no rows, other
    columns are ignored.
    """
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    classes = materialize(
        signed.filter("k1 is not null").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    halves = classes.select("node", F.posexplode("halves").alias("i", "h"))
    shared = halves.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    places = halves.join(shared, "h").groupBy("node").agg(F.collect_list("i").alias("places"), F.sum("c").alias("weight"))
    candidates = materialize(
        classes.join(places, "node")
        .withColumn("u", F.filter("places", lambda i: i < HALVES)).withColumn("v", F.filter("places", lambda i: i >= HALVES))
        .filter("size(u) > 0 and size(v) > 0").drop("places"),
        "candidates",
    )
    z = narrow(docs, id_col, text_col).mapInArrow(Lean(compressed), "doc_id long, z binary")
    texts = materialize(
        z.join(candidates.select("node", "rep", "k1", "k2"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "k1", "k2", "z").mapInArrow(Lean(_matching), "node long, z binary, bits array<long>, fell long"), "candidate-texts"
    )

    nodes = candidates.select("node", "n", "weight", "halves", "signature", "u", "v", F.col("node").alias("label"))
    links = None
    for step in range(ROUNDS):
        found = _links(_stars(nodes, step), texts)
        links = found if links is None else links.union(found)
        labels = components(links)
        nodes = materialize(nodes.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    final = materialize(components(links.union(_links(_across(nodes, texts), texts))), "near-labels")

    named = classes.select("k1", "k2", "rep", "node").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = named.join(smallest, "label").select("k1", "k2", "component_id")
    grouped = signed.filter("k1 is not null").select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"])
    alone = signed.filter("k1 is null").select("doc_id", "n_shingles", "k1", "k2", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

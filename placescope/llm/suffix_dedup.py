"""Operator 4: removal of byte strings that occur elsewhere, by a depth-limited radix sort of suffixes.

Only the first ``LENGTH`` bytes of a suffix matter: equal groups at that depth are the repeated windows.
The most significant digit of a window is its anchor, the lowest-hashed gram of ``GRAM`` bytes in it,
with its place in the window; windows that follow one another and share an anchor travel as one run. The
first pass deals runs by anchor and drops anchors that occur once, which is nearly all of unique text. For the
rest the bytes are fetched and the windows pass through two more digits, the bytes before and those
behind the anchor, each pass dropping groups of one. An anchor with many runs is dealt to several tasks, whose windows that
are single there are matched in one more grouping by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescope.llm.arrow import BLOCK_BYTES, Batches, Lean, blocks, buffers
from placescope.llm.bytehash import _INVERSE, _power_table, digests, mix, sums
from placescope.llm.minhash import compressed
from placescope.session import materialize

LENGTH, GRAM = 200, 72
#: Runs of one anchor that one task takes.
SHARE = 2_000
#: Windows that one vectorised step of a task sorts, apart from those of one anchor.
STEP_WINDOWS = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
_C = np.uint64(0x9E3779B97F4A7C15)


def _lowest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (width - size)], key[width - size :]) if width > size else key


def anchor_runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor (``length`` is below 4096): anchor hash, first window, number of windows, anchor's place in the first.

    ``bounds`` are the byte offsets of the rows of the block; no window crosses them. At most 2**20 bytes.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    running = sums(data)
    hashed = mix((running[gram:] - running[:-gram]) * _power_table(_INVERSE, n + 1)[: n - gram + 1])
    place = (_lowest((hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
    change = np.zeros(n + 2, dtype=np.int8)
    begin, end = bounds[:-1], bounds[1:]
    full = end - begin >= length
    change[begin[full]] = 1
    change[end[full] - length + 1] -= 1
    valid = np.cumsum(change[: len(place)], dtype=np.int8) > 0
    fresh = valid.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    first = np.flatnonzero(fresh)
    return hashed[place[first]].astype(np.int64), first, np.flatnonzero(last) - first + 1, place[first] - first


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            ids, keys = batch.column(0), batch.column(1)
            for low, high in blocks(offsets):
                # A longer text goes in parts that overlap by all but one byte of a window.
                for base in range(offsets[low], max(offsets[high], offsets[low] + 1), BLOCK_BYTES):
                    end = min(offsets[high], base + BLOCK_BYTES + length - 1) if high == low + 1 else offsets[high]
                    bounds = np.clip(offsets[low : high + 1], base, end) - base
                    anchor, first, count, place = anchor_runs(data[base:end], bounds, length, gram)
                    row = np.searchsorted(bounds, first, side="right") - 1 + low
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), keys.take(at), pa.array(anchor), pa.array((first + base - offsets[row]) << 24 | count << 12 | place)],
                        names=["doc_id", "tk", "anchor", "run"],
                    )
                    if high > low + 1:
                        break

    return run


def _contexts(length: int, gram: int):
    """The bytes of each run's windows, cut out of its text, without those of the anchor, which all share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                text = unpacker.decompress(batch.column("z")[r].as_py())
                runs = batch.column("runs")[r].values
                run = runs.field("run").to_numpy()
                start, count, place = run >> 24, run >> 12 & 4095, run & 4095
                parts = pa.array(
                    [text[s : s + p] + text[s + p + gram : s + k + length - 1] for s, k, p in zip(start.tolist(), count.tolist(), place.tolist(), strict=True)], pa.binary()
                )
                # By id as well as text, so that copies of one text spread, and by number among the runs of rows that share both.
                salt = mix(np.array([batch.column("doc_id")[r].as_py() or 0], np.int64).astype(np.uint64)) + np.uint64((batch.column("tk")[r].as_py() or 0) & (1 << 63) - 1)
                if len(np.unique(run)) < len(run):
                    salt = mix(salt + pd.Series(run).groupby(run).cumcount().to_numpy().astype(np.uint64))
                share = (mix(start.astype(np.uint64) * _C + salt) % runs.field("shares").to_numpy().astype(np.uint64)).astype(np.int64)
                same = pa.array([r] * len(runs), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(same), batch.column("tk").take(same), runs.field("anchor"), runs.field("shares"), pa.array(run), pa.array(share), parts],
                    names=["doc_id", "tk", "anchor", "shares", "run", "share", "part"],
                )

    return run


def _kept(code: np.ndarray, keep_all: np.ndarray) -> np.ndarray:
    return (np.bincount(code)[code] > 1) | keep_all


def sorted_windows(group: pa.Table, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Radix passes over the windows of whole groups of runs.

    Gives a row of kind 0 for each stretch of repeated windows, and for anchors dealt to several tasks a
    row of kind 1 for each distinct window with its number here and one of its places.
    """
    parts, offsets = buffers(group.column("part"))
    base = offsets[0]
    run = group.column("run").to_numpy()
    count, place, start = run >> 12 & 4095, run & 4095, run >> 24
    anchor, dealt = group.column("anchor").to_numpy().astype(np.uint64), group.column("shares").to_numpy() > 1
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[row] - base + step
    running = sums(parts[base : offsets[-1]])
    live, keep_all = np.arange(len(row)), dealt[row]
    key = mix(anchor[row] + (place[row] - step).astype(np.uint64) * _C)
    code = pd.factorize(key)[0]
    middle = offsets[row] - base + place[row]
    behind = at + length - gram
    for first, last in ((None, None), (at, middle), (middle, behind)):
        if first is not None:
            key = mix(key * _C + digests(running, first[live], last[live]))
            code = pd.factorize(key)[0]
        stays = _kept(code, keep_all[live])
        live, key, code = live[stays], key[stays], code[stays]
    number = np.bincount(code)[code] if len(code) else np.zeros(0, np.int64)
    repeated = live[number > 1]
    names = ["kind", "doc_id", "tk", "start", "length", "digest", "n"]
    ids, keys = group.column("doc_id").combine_chunks(), group.column("tk").combine_chunks()

    def batch(kind: int, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, digest: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), kind, np.int32)), ids.take(at), keys.take(at), pa.array(starts), pa.array(lengths), pa.array(digest), pa.array(n)], names=names
        )

    if len(repeated):
        breaks = np.flatnonzero((np.diff(repeated) != 1) | (np.diff(row[repeated]) != 0))
        a, b = repeated[np.r_[0, breaks + 1]], repeated[np.r_[breaks, len(repeated) - 1]]
        zero = np.zeros(len(a), np.int64)
        yield batch(0, row[a], start[row[a]] + step[a], b - a + length, zero, zero)
    spread = keep_all[live]
    if spread.any():
        _, some = np.unique(code[spread], return_index=True)
        w = live[spread][some]
        yield batch(1, row[w], start[row[w]] + step[w], np.full(len(w), length, np.int64), key[spread][some].astype(np.int64), number[spread][some].astype(np.int64))


def window_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``STEP_WINDOWS`` windows at most, or of one run."""
    for batch in batches:
        reach = np.cumsum(batch.column("run").to_numpy() >> 12 & 4095)
        low = 0
        while low < batch.num_rows:
            before = int(reach[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(reach, before + STEP_WINDOWS, side="right")))
            yield batch.slice(low, high - low)
            low = high


def _radix(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in window_steps(batches):
            held.append(batch)
            windows += int((batch.column("run").to_numpy() >> 12 & 4095).sum())
            if windows < STEP_WINDOWS:
                continue
            table = pa.Table.from_batches(held)
            keys = np.stack([table.column(c).to_numpy() for c in ("anchor", "share")])
            changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            if len(changes):  # all but the last group are whole
                cut = int(changes[-1]) + 1
                yield from sorted_windows(table.slice(0, cut), length, gram)
                table = table.slice(cut)
            held, windows = table.to_batches(), int((table.column("run").to_numpy() >> 12 & 4095).sum())
        if held:
            yield from sorted_windows(pa.Table.from_batches(held), length, gram)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tk, start, length): stretches of bytes covered by repeated windows, not yet merged.

    ``docs`` has doc_id, text and tk, a hash of the text that tells rows with equal ids apart.
    """
    # Computed twice, for the counts and for the rows: that costs less than writing the rows.
    runs = docs.select("doc_id", "tk", "text").mapInArrow(Lean(_runs(length, gram)), "doc_id long, tk long, anchor long, run long")
    counts = runs.select("anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # Written, so that the join reads both sides from a shuffle of its own and can split a hot anchor's rows.
    shared = materialize(counts.select("anchor", F.ceil(F.col("c") / SHARE).alias("shares")), "repeated-anchors")
    repeated = runs.join(shared, "anchor").groupBy("doc_id", "tk").agg(F.collect_list(F.struct("anchor", "shares", "run")).alias("runs"))
    z = docs.select("doc_id", "tk", "text").mapInArrow(Lean(compressed), "doc_id long, tk long, z binary")
    same = z["doc_id"].eqNullSafe(repeated["doc_id"]) & (z["tk"] == repeated["tk"])
    # Sort-merge however small one side is: after a broadcast join each task would need a second Python worker.
    with_text = z.join(repeated.hint("merge"), same).select(z["doc_id"], z["tk"], "z", "runs")
    parts = with_text.mapInArrow(Lean(_contexts(length, gram)), "doc_id long, tk long, anchor long, shares long, run long, share long, part binary")
    found = materialize(
        parts.repartition("anchor", "share").sortWithinPartitions("anchor", "share").mapInArrow(Lean(_radix(length, gram)), "kind int, doc_id long, tk long, start long, length long, digest long, n long"),
        "repeated-windows",
    )
    spread = found.filter("kind = 1")
    across = spread.groupBy("digest").agg(F.sum("n").alias("total")).filter("total > 1").select("digest")
    columns = ["doc_id", "tk", "start", "length"]
    return found.filter("kind = 0").select(columns).union(spread.filter("n = 1").join(across, "digest").select(columns))


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return list(zip(start[first].tolist(), reach[np.r_[first[1:] - 1, len(reach) - 1]].tolist(), strict=True))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part, out = batch.slice(low, 500), []
            for z, spans in zip(part.column("z"), part.column("spans"), strict=True):
                text, merged = unpacker.decompress(z.as_py()), []
                if spans.is_valid:
                    start, size = spans.values.field("start").to_numpy(), spans.values.field("length").to_numpy()
                    merged = _merged(start, start + size)
                kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), len(merged), kept))
            if out:
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "carried")), *columns], names=["doc_id", "carried", "n_bytes", "n_removed", "n_spans", "kept"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _applied(batches):
        texts = [b.as_py().decode("utf-8", "ignore") for b in batch.column("kept")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("carried"), pa.array(texts, pa.string())], names=["doc_id", "carried", "text"])


def _cut(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str, carry: tuple[str, ...], run: Batches, columns: str) -> DataFrame:
    """What ``run`` makes of each row's compressed text and repeated spans: doc_id, ``carry`` as a struct and ``columns``."""
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(0).alias("none"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), carried.alias("carried"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    spans = repeated_spans(d.drop("carried"), length, gram).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    kind = d.schema["carried"].dataType.simpleString()
    z = d.select("doc_id", "tk", "carried", "text").mapInArrow(Lean(compressed), f"doc_id long, tk long, carried {kind}, z binary")
    same = z["doc_id"].eqNullSafe(spans["doc_id"]) & (z["tk"] == spans["tk"])
    joined = z.join(spans.hint("merge"), same, "left").select(z["doc_id"], "carried", "z", "spans")
    return joined.mapInArrow(Lean(run), f"doc_id long, carried {kind}, {columns}")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of every row, and ``carry`` as a struct.

    A byte goes if a ``length``-byte string over it starts anywhere else, in the same or another row;
    overlaps count, and strings are judged on the input. Null is an empty text. Rows with equal ids and
    texts count as two texts; other columns are ignored; an empty table gives no rows. ``gram`` is at
    most ``length``.
    """
    return _cut(docs, length, gram, id_col, text_col, carry, _applied, "n_bytes long, n_removed long, n_spans long, kept binary")


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of its texts; bytes of a character cut in two go as well."""
    carry = tuple(c for c in docs.columns if c not in (id_col, text_col))
    rows = _cut(docs, length, gram, id_col, text_col, carry, _decoded, "text string")
    source = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return rows.select(*(source.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def removal_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    out = without_repeats(docs, length, gram)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """What ``removal_digests`` gives for a few texts: removed bytes, spans and digest."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest()))
    return out

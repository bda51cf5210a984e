"""Operator 1: pack token sequences into as few fixed-length sequences as possible.

Only the histogram of piece lengths (at most one count per token length) reaches the driver. There the
configuration linear program is solved approximately by multiplicative weights: a knapsack dynamic
program prices the configurations, the weight of a length falls as it gets covered. The fractional
solution is rounded under the counts and the rest is filled best-fit. Pieces then find their slot by
their rank among pieces of equal length, with no group in one task.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placescope.llm.arrow import Lean, blocks, buffers, narrow
from placescope.session import materialize

CAPACITY = 4096
END = 1
#: Rounds of the multiplicative weights.
ROUNDS = 24
#: Rows of one length that one ranking task takes.
RANK_ROWS = 1_000
#: Bytes of words and ids that a Python worker keeps before it starts anew.
CACHE_BYTES = 16 << 20
#: Bytes of text that are split and looked up together; a longer text is a block of its own.
TEXT_BYTES = 2 << 20
#: What every added token of the vocabulary begins with.
SPECIAL = b"<|"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _STOP, _LETTER = (np.zeros(256, dtype=bool) for _ in range(3))
_BLANK[[9, 10, 13, 32]] = True
_STOP[[ord(","), ord(".")]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SELF)}

Pattern = tuple[tuple[int, int], ...]  # (length, how often), lengths descending


def price(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best value for each capacity and the length taken last."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, side="right")
        best[c], taken[c] = best[c - 1], 0
        if k:
            value = prices[:k] + best[c - lengths[:k]]
            at = int(value.argmax())
            if value[at] > best[c]:
                best[c], taken[c] = value[at], lengths[at]
    return best, taken


def _trace(first: int, taken: np.ndarray, capacity: int) -> Pattern:
    items, left = {first: 1}, capacity - first
    while left > 0:
        length = int(taken[left])
        if length == 0:
            left -= 1
            continue
        items[length] = items.get(length, 0) + 1
        left -= length
    return tuple(sorted(items.items(), reverse=True))


def fractional(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[Pattern, float]:
    """An approximate solution of the configuration linear program, averaged over the rounds.

    Each round prices all lengths, takes for each length the best configuration that holds it, and
    lowers the price of a length by what covered it beyond its need.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(x)] for x in lengths], dtype=float)
    weights, place = lengths / capacity, {int(x): i for i, x in enumerate(lengths)}
    solution: dict[Pattern, float] = {}
    for _ in range(rounds):
        _, taken = price(lengths, weights, capacity)
        cover, chosen = np.zeros(len(lengths)), []
        for i, length in enumerate(lengths):
            pattern = _trace(int(length), taken, capacity)
            amount = need[i] / sum(k for _, k in pattern)
            chosen.append((pattern, amount))
            for x, k in pattern:
                cover[place[x]] += k * amount
        scale = need.sum() / max(cover.sum(), 1e-12)
        for pattern, amount in chosen:
            solution[pattern] = solution.get(pattern, 0.0) + amount * scale / rounds
        weights = weights * np.exp(-0.25 * np.clip(cover * scale / need - 1, -1, 4) * lengths / capacity)
        weights *= (lengths / capacity * need).sum() / (weights * need).sum()
    return solution


def rounded(counts: dict[int, int], solution: dict[Pattern, float], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Whole numbers of configurations that use every piece exactly once; the rest goes best-fit."""
    left, out = dict(counts), []
    for pattern, amount in sorted(solution.items(), key=lambda x: (capacity - sum(a * b for a, b in x[0]), -x[1], x[0])):
        n = min([int(np.ceil(amount - 1e-9)), *(left[length] // k for length, k in pattern)])
        if n > 0:
            out.append((pattern, n))
            for length, k in pattern:
                left[length] -= n * k
    return out + best_fit({k: n for k, n in left.items() if n}, capacity)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal bins are kept as one entry with a count."""
    gaps: list[int] = []
    bins: dict[int, list[tuple[Pattern, int]]] = {}

    def put(pattern: Pattern, n: int, gap: int) -> None:
        if gap not in bins:
            bisect.insort(gaps, gap)
            bins[gap] = []
        bins[gap].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                gap, pattern, n = capacity, (), -(-left // (capacity // length))
            else:
                gap = gaps[at]
                pattern, n = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[at]
            each = min(gap // length, left)
            full = min(n, left // each)
            if full:
                put((*pattern, (length, each)), full, gap - each * length)
                left -= full * each
            if full < n:
                rest = n - full
                if left and left < each:
                    put((*pattern, (length, left)), 1, gap - left * length)
                    left, rest = 0, rest - 1
                if rest and pattern:
                    put(pattern, rest, gap)
    return [x for group in bins.values() for x in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Slots by (length, rank of the piece): runs of equal slots as sorted arrays.

    The number of runs depends on the capacity and the rounds, not on the number of pieces.
    """
    inner = {k: n for k, n in counts.items() if 0 < k < capacity}
    packs = [(((capacity, 1),), counts[capacity])] if counts.get(capacity) else []
    if inner:
        packs += rounded(inner, fractional(inner, capacity, rounds), capacity)
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for pattern, n in packs:
        offset = 0
        for length, k in pattern:
            runs.append((length, used.get(length, 0), sequence, k, offset))
            used[length] = used.get(length, 0) + n * k
            offset += length * k
        sequence += n
    assert used == {k: n for k, n in counts.items() if k > 0}
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 44 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


_tokenizers: dict[str, Words] = {}


def _words_of(key: str, text) -> Words:
    """Tokenizer and word cache of this Python worker."""
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers.clear()
        _tokenizers[key] = Words(Tokenizer.from_str(text()))
    return _tokenizers[key]


def _gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices [first, first + size) of ``values``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))]


class Words:
    """Ids of words, as flat arrays; a word is tokenised again only after the cache was full.

    The tokenizer drops white space and never joins across it, nor across a comma or full stop that ends
    a word behind a letter. It lower-cases after composing characters; for rows in Latin-1, where nothing
    composes, A-Z may be lower-cased first. Rows that hold ``SPECIAL`` are given to it whole, as only there
    its added tokens can match.
    """

    def __init__(self, tokenizer, most: int = CACHE_BYTES) -> None:
        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most
        mark = tokenizer.encode("0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words and their number for each.

        A word of Latin-1 letters is one piece that nothing composes: it goes to the model at once. Of the
        others those without the digit 0 go together in longer texts, a 0 between them.
        """
        found: list[list[int]] = [[]] * len(words)
        plain, single = [], []
        for k, w in enumerate(words):
            if w.isalpha() and (w.isascii() or max(w) <= "\xff"):
                w = w.lower()
                found[k] = [x.id for x in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            elif self.mark is not None and "0" not in w:
                plain.append(k)
            else:
                single.append(k)
        for at in range(0, len(plain), 64):
            some = plain[at : at + 64]
            ids: list[int] = self.tokenizer.encode(" 0 ".join([words[k] for k in some]) + " 0", add_special_tokens=False).ids
            first = 0
            for k in some:
                end = ids.index(self.mark, first)
                found[k], first = ids[first:end], end + 1
        for k in single:
            found[k] = self.tokenizer.encode(words[k], add_special_tokens=False).ids
        sizes = np.fromiter(map(len, found), np.int64, len(words))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct ``words`` stand in the cache; those that are missing come in."""
        at = pc.index_in(words, value_set=self.known)  # builds its hash table anew: one call a block
        if not at.null_count:
            return at.to_numpy().astype(np.int64)
        new, place = words.filter(at.is_null()), at.fill_null(-1).to_numpy().astype(np.int64)
        if self.known.nbytes + self.ids.nbytes + self.ends.nbytes > self.most:
            self._forget()
            new, place = words, np.full(len(words), -1, np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        ids, sizes = self._encode(new.to_pylist())
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.known = pa.concat_arrays([self.known, new])
        return place

    def block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a block of texts, each closed by ``END``, and the rows' offsets in them."""
        rows = len(bounds) - 1
        whole = data.tobytes()
        special: dict[int, np.ndarray] = {}
        at = whole.find(SPECIAL)
        while at >= 0:
            k = int(np.searchsorted(bounds, at, side="right")) - 1
            text = whole[bounds[k] : bounds[k + 1]]
            if SPECIAL in text:
                special[k] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
                at = int(bounds[k + 1]) - 1
            at = whole.find(SPECIAL, at + 1)
        low = _LOWER[data]
        wide = np.flatnonzero(data >= 0xC4)
        for k in np.unique(np.searchsorted(bounds, wide, side="right") - 1):
            low[bounds[k] : bounds[k + 1]] = data[bounds[k] : bounds[k + 1]]
        blank = _BLANK[data]
        for k in special:
            blank[bounds[k] : bounds[k + 1]] = True
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        kept = ~blank
        start = kept & edge[:n]
        start[1:] |= kept[1:] & blank[:-1]
        if n > 1:
            closes = edge[1:].copy()  # the last byte of a row or word
            closes[:-1] |= blank[1:]
            start[1:] |= kept[1:] & closes[1:] & ~edge[1:n] & _STOP[data[1:]] & _LETTER[data[:-1]]
        first = np.flatnonzero(start)
        row = np.searchsorted(bounds, first, side="right") - 1
        inside = np.cumsum(kept)  # bytes of words up to and with this one
        offsets = np.concatenate([inside[first] - 1, inside[-1:] if n else np.zeros(1, np.int64)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(low[kept])).dictionary_encode()
        place = self._places(words.dictionary)[words.indices.to_numpy()] if len(first) else np.zeros(0, np.int64)
        begin, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        lengths = np.bincount(row, weights=sizes, minlength=rows).astype(np.int64) + 1
        for k, ids in special.items():
            lengths[k] = len(ids) + 1
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]) if rows else 0, np.uint32)
        out[ends - 1] = END
        free = np.ones(len(out), bool)
        free[ends - 1] = False
        for k, ids in special.items():
            out[ends[k] - 1 - len(ids) : ends[k] - 1] = ids
            free[ends[k] - 1 - len(ids) : ends[k] - 1] = False
        out[free] = _gathered(self.ids, begin, sizes)
        return out, np.concatenate([[0], ends])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, whose ids end with id 1.

    Texts are looked up ``text_bytes`` at a time: half as much takes 40 MB less of a worker and a sixth more time.
    """
    with open(path, encoding="utf-8") as f:  # a vocabulary file: its length does not depend on the input
        text = f.read()
    key, shared = hashlib.sha256(text.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words_of(key, lambda: shared.value)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for begin, end in blocks(offsets, text_bytes):
                ids, ends = words.block(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
                lengths = np.diff(ends)
                count = -(-lengths // capacity)
                n = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                start = n * capacity
                size = np.minimum(np.repeat(lengths, count) - start, capacity)
                at = np.repeat(ends[:-1], count) + start
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                doc = batch.column(0).slice(begin, end - begin).take(pa.array(np.repeat(np.arange(end - begin), count)))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return narrow(docs, id_col, text_col).mapInArrow(Lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Give every piece a sequence_id and an offset; ``cut`` has the columns of ``pieces``.

    ``cut`` is written once before it is counted and ranked. Ties and repeated rows are interchangeable:
    each gets a slot of its own. An empty table gives no rows.
    """
    cut = materialize(cut, "pieces")
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in histogram.collect()}  # at most one row per length up to the capacity
    spark = cut.sparkSession
    slots = spark.sparkContext.broadcast(plan(counts, capacity, rounds))
    # As an Arrow table; rows of Python would pass through Python workers of their own, which then stay.
    dealt_to = {k: -(-n // RANK_ROWS) for k, n in counts.items()} or {0: 1}
    shares = spark.createDataFrame(pa.table({"length": pa.array(dealt_to.keys(), pa.int64()), "shares": pa.array(dealt_to.values(), pa.int64())}))
    dealt = cut.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("shares"))).drop("shares")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")).select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(bases, ["length", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(table["key"], length << 44 | rank, side="right") - 1
            inner = rank - table["rank"][at]
            sequence = table["sequence"][at] + inner // table["each"][at]
            offset = table["offset"][at] + inner % table["each"][at] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank")).mapInArrow(
        Lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def packed(
    docs: DataFrame, path: str, capacity: int = CAPACITY, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = TEXT_BYTES
) -> DataFrame:
    """Cut and pack every document of ``docs``.

    A null or empty text is one piece that holds the closing id alone; only documents longer than
    ``capacity`` are cut. Rows with equal or null ids are packed one by one; other columns are ignored.
    """
    return pack(pieces(docs, path, capacity, id_col, text_col, text_bytes), capacity, rounds)

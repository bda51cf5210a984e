"""Operator 3: byte-level BPE encoding and decoding by a rank file."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from placescope.llm.arrow import narrow, strings

#: Entries that each cache of a Python worker holds before it starts anew. A cache saves time only.
CACHE = 500_000
#: Longest piece in bytes that is merged in lockstep with others and kept in a cache.
LOCKSTEP = 64
#: Texts, and characters of text, that one step of a task encodes.
STEP_ROWS, STEP_CHARS = 1_024, 4_000_000
#: White space before a space: such texts are cut by the pattern as a whole.
_ODD_SPACE = re.compile(r"\s ")
#: All characters below are assigned, but for a few from U+0378 on that no pattern class holds.
_HIGH = re.compile("[\u0378-\U0010ffff]")


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank from lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: always merge the leftmost pair of lowest rank.

    A segment tree over the byte positions holds at leaf i the key ``rank * size + i`` of the pair that
    starts there, so its root names the next merge; a merge updates the leaf of the pair, of its left
    neighbour and of the part that went, each in a logarithmic number of steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    size = 1 << max(n - 1, 1).bit_length()
    mask, none = size - 1, 1 << 62
    get = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for at in range(size - 1, 0, -1):
        a, b = tree[2 * at], tree[2 * at + 1]
        tree[at] = a if a < b else b
    while tree[1] != none:
        i = tree[1] & mask
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        changes = [(j, none)]
        end = after[k] if k < n else 0
        rank = get(piece[i:end]) if end else None
        changes.append((i, none if rank is None else rank * size + i))
        left = before[i]
        if left >= 0:
            rank = get(piece[left:k])
            changes.append((left, none if rank is None else rank * size + left))
        for leaf, key in changes:
            at = size + leaf
            tree[at] = key
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


class PairTable:
    """Rank of the merge of two adjacent tokens, looked up for whole arrays of id pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bits = max(ranks.values()).bit_length()
        found = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found.append((a << self.bits | b, rank))
        table = np.array(sorted(found) or [(-1, -1)], dtype=np.int64)
        self.keys, self.merged = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << self.bits | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)


def merge_many(pieces: list[bytes], size: int, pairs: PairTable) -> list[tuple[int, ...]]:
    """``merge`` for many pieces of at most ``size`` bytes in lockstep: one segment tree per row.

    Every step merges the pair at each tree's root and updates three leaves and their ancestors; rows
    whose root is empty drop out.
    """
    rows, shift, none = len(pieces), size.bit_length() - 1, np.int64(1 << 62)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, size)
    live = np.arange(size) < lengths[:, None]
    ids = np.where(live, pairs.byte[raw], -1)
    after = np.tile(np.arange(1, size + 1), (rows, 1))
    before = np.tile(np.arange(-1, size), (rows, 1))
    tree = np.full((rows, 2 * size), none)

    def keys(rank: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return np.where(rank < 0, none, rank << shift | leaf)

    r, c = np.nonzero(live[:, 1:])
    tree[r, size + c] = keys(pairs.rank(ids[r, c], ids[r, c + 1]), c)
    at = size >> 1
    while at:
        np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2], out=tree[:, at : 2 * at])
        at >>= 1
    active = np.arange(rows)
    while True:
        root = tree[active, 1]
        active, root = active[root != none], root[root != none]
        if not len(active):
            break
        i = root & (size - 1)
        j = after[active, i]
        k = after[active, j]
        ids[active, i], ids[active, j] = root >> shift, -1
        after[active, i], before[active, k] = k, i
        has = k < lengths[active]
        own, left = np.full(len(active), -1), before[active, i]
        own[has] = pairs.rank(ids[active[has], i[has]], ids[active[has], k[has]])
        leaves = [(active, j, np.full(len(active), none)), (active, i, keys(own, i))]
        has = left >= 0
        rows_left, left = active[has], left[has]
        leaves.append((rows_left, left, keys(pairs.rank(ids[rows_left, left], ids[rows_left, i[has]]), left)))
        for row, leaf, key in leaves:
            at = size + leaf
            tree[row, at] = key
            for _ in range(shift):
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
    keep = ids >= 0
    flat = ids[keep].tolist()
    ends = np.cumsum(keep.sum(axis=1)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


class Codec:
    """Encoder and decoder of one rank file and splitting pattern.

    A space after a character that is not white space always starts a new piece, so a text is cut at
    such spaces and the ids of each part are kept in a cache; parts and pieces that are not there go
    through the pattern and the segment tree.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.token = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.pattern = regex.compile(pattern)
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        """Matches of the pattern. Unassigned characters, on which Unicode tables differ, count as symbols."""
        if _HIGH.search(text) is None or not any(category(c) == "Cn" for c in text):
            return self.pattern.findall(text)
        shown = "".join("\u2020" if category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]

    def _learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pieces that no cache holds."""
        found: dict[str, tuple[int, ...]] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                found[piece] = (rank,)
            elif len(raw) > LOCKSTEP:
                found[piece] = merge(raw, self.ranks)
            else:
                by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for size, group in by_size.items():
            for first in range(0, len(group), 4096):
                some = group[first : first + 4096]
                found.update(zip((p for p, _ in some), merge_many([raw for _, raw in some], size, self.pairs), strict=True))
        return found

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts. Memory: the texts, their ids and two caches of bounded size."""
        if len(self.parts) >= CACHE:
            self.parts.clear()
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        cut = [None if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        parts = set(chain.from_iterable(c[1:] for c in cut if c)).difference(self.parts)
        pieces = {p: self.split(" " + p) for p in parts}
        heads = [self.split(t) if c is None else self.split(c[0]) for t, c in zip(texts, cut, strict=True)]
        new = self._learn(set(chain(chain.from_iterable(pieces.values()), chain.from_iterable(heads))).difference(self.pieces))
        known = self.pieces
        known.update(new)
        for part, own in pieces.items():
            self.parts[part] = known[own[0]] if len(own) == 1 else tuple(chain.from_iterable(map(known.__getitem__, own)))
        out = []
        for head, c in zip(heads, cut, strict=True):
            ids = list(chain.from_iterable(map(known.__getitem__, head)))
            if c:
                ids.extend(chain.from_iterable(map(self.parts.__getitem__, c[1:])))
            out.append(ids)
        for group in (self.parts, self.pieces):  # very long parts are not worth their room
            for key in [k for k in (parts if group is self.parts else new) if len(k) > LOCKSTEP]:
                del group[key]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def text_of(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(key: str, raw: Callable[[], bytes], pattern: str) -> Codec:
    """The codec of this Python worker; its tables and caches outlive a task."""
    if (key, pattern) not in _codecs:
        _codecs.clear()
        _codecs[key, pattern] = Codec(parse_ranks(raw()), pattern)
        gc.freeze()  # the tables hold no cycles; walking them again and again would cost more than encoding
        gc.disable()
    return _codecs[key, pattern]


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of a batch in steps of bounded size."""
    ids, texts, first, size = batch.column(0), [], 0, 0
    for n, text in enumerate(strings(batch.column(1)), 1):
        texts.append(text)
        size += len(text)
        if len(texts) >= STEP_ROWS or size >= STEP_CHARS or n == batch.num_rows:
            yield ids.slice(first, len(texts)), texts
            texts, first, size = [], n, 0


def _shared_ranks(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # a vocabulary file: its length does not depend on the input
        raw = f.read()
    return hashlib.sha256(raw).hexdigest(), docs.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every whole text. Null is empty; an empty text has no ids.

    Rows with equal or null ids are encoded one by one, other columns are ignored, an empty table gives
    no rows. Memory per task: one batch, the vocabulary and two caches of bounded size.
    """
    key, raw = _shared_ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, lambda: raw.value, pattern)
        for batch in batches:
            for doc, texts in _steps(batch):
                yield pa.RecordBatch.from_arrays([doc, pa.array(codec.encode_all(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for."""
    key, raw = _shared_ranks(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, lambda: raw.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of what they decode to, in one pass; cases as for ``encode``."""
    key, raw = _shared_ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, lambda: raw.value, pattern)
        for batch in batches:
            for doc, texts in _steps(batch):
                counts, ids_sha, data_sha = [], [], []
                for ids in codec.encode_all(texts):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(codec.text_of(ids).encode()).hexdigest())
                    data_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Operators 1, 3, 5, 6 and 8 against plain Python on small tables with odd rows."""

import base64
import hashlib
import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from placescope.llm import bpe, exact_dedup, packing, quality, warc

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, "a"), (4, "  two  spaces \n\n and\ttabs "), (5, "It's we'll I'D naïve ÀÉ ΣΑΣ 日本語 ́"), (6, "x" * 5000 + " end"),
    (7, "word " * 9000), (7, "word " * 9000), (None, "no id"), (8, "<|endoftext|> 100 000 a.b, c. d,e"), (9, "\U0003dd3c's   x  y"),
]


def test_bpe_equals_tiktoken_and_decodes_back(spark, docs_of):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD)
    encoded = bpe.encode(docs_of(ODD), RANKS, public_tokenizers.PATTERN)
    got = sorted((str(r.doc_id), r.ids) for r in encoded.collect())
    assert got == [(i, ids) for i, ids, _ in want]
    back = sorted((str(r.doc_id), bytes(r.data)) for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect())
    assert back == sorted((i, data) for i, _, data in want)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    rows = bpe.round_trip(docs_of(ODD), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest(data)) for i, ids, data in want)
    assert bpe.round_trip(docs_of([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_segment_tree_lockstep_and_plain_merges_agree():
    ranks = bpe.parse_ranks(open(RANKS, "rb").read())
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    some = ["".join(rnd.choice("abeinst ") for _ in range(rnd.randint(2, 60))) for _ in range(300)]
    want = [tuple(enc.encode_ordinary(s)) for s in some]
    assert [bpe.merge(s.encode(), ranks) for s in some] == want
    codec = bpe.Codec(ranks, r"[\s\S]+")
    learned = codec._learn(set(some))
    assert [learned[s] for s in some] == want
    long = "".join(rnd.choice("abeinst") for _ in range(20_000))
    assert list(bpe.merge(long.encode(), ranks)) == enc.encode_ordinary(long)


def _check_packing(rows, docs):
    tok = Tokenizer.from_file(WORDS)
    want = []
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for n, s in enumerate(range(0, len(ids), 4096)):
            piece = ids[s : s + 4096]
            want.append((str(i), n, s, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


@pytest.mark.parametrize("most", [packing.CACHE_BYTES, 4096])
def test_packing_ids_equal_the_untouched_tokenizer(most):
    """Special tokens, composing characters, case, digits and punctuation, with a cache that overflows."""
    tok, rnd = Tokenizer.from_file(WORDS), random.Random(5)
    parts = (
        "<|endoftext|> <|startoftext|> <|ENDOFTEXT|> <| |> a B It's we'LL 'S. word, Word. x.y, é É ẘ W̊ e\u0301 E\u0301. \u0301 Σ ΑΣ ΑΣ. ß İ 日本 0 10 0, 😀 a😀. ... ., , "
        "- \u212b ﬁ …  ’s Don’t. \ufeff Ǆ \x00 \x0b \x0c \x85 \xa0 ª º\xad"
    ).split(" ") + ["\r\n", "\t", "\x1d x"]
    texts = [None, "", " ", ".", ",a"] + ["".join(rnd.choice(parts) + rnd.choice(["", " ", "  ", "\n", ". ", ", "]) for _ in range(rnd.randint(1, 14))) for _ in range(4000)]
    words = packing.Words(Tokenizer.from_file(WORDS), most)
    data, offsets = packing.buffers(pa.array(texts))
    for begin, end in packing.blocks(offsets, 1 << 13):
        ids, ends = words.block(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
        for k in range(begin, end):
            assert ids[ends[k - begin] : ends[k - begin + 1]].tolist() == [*tok.encode(texts[k] or "", add_special_tokens=False).ids, 1]


def test_packing_ids_offsets_and_bins(spark, docs_of):
    rnd = random.Random(1)
    docs = ODD + [(100 + k, " ".join(rnd.choice(("alpha", "beta", "Gamma,", "x.")) for _ in range(rnd.randint(1, 900)))) for k in range(300)]
    rows = packing.packed(docs_of(docs), WORDS).collect()
    used = _check_packing(rows, docs)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 2
    assert packing.packed(docs_of([]), WORDS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_uses_every_piece_once_and_few_bins(seed):
    rnd = random.Random(seed)
    counts = {rnd.randint(1, 60): rnd.randint(1, 400) for _ in range(rnd.randint(1, 40))} | ({60: 7} if seed % 2 else {})
    assert packing.plan(counts, capacity=60, rounds=12)["sequence"].max() + 1 >= -(-sum(k * n for k, n in counts.items()) // 60)
    plain = sum(n for _, n in packing.best_fit(dict(counts), 60))
    packs = packing.rounded({k: n for k, n in counts.items() if k < 60}, packing.fractional({k: n for k, n in counts.items() if k < 60} or {1: 1}, 60, 12), 60)
    assert sum(n for _, n in packs) + counts.get(60, 0) <= plain + max(1, plain // 50)
    used = {}
    for pattern, n in packs:
        assert sum(a * b for a, b in pattern) <= 60
        for a, b in pattern:
            used[a] = used.get(a, 0) + b * n
    assert used == {k: n for k, n in counts.items() if k < 60}


def _figures(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, marked = {}, set()
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked.update(i + k for i in at for k in range(8))
    return len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in text), len(ls) - len(set(ls)), len(marked)


def test_quality_figures_equal_plain_python(docs_of):
    rnd = random.Random(5)
    docs = ODD + [(50 + k, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60)))) for k in range(60)]
    docs += [(300, "line one\nline one\n\n \n\t\nline one"), (301, "a b c d e f g h " * 3), (302, "#" * 50), (303, "LOUD WORDS HERE " * 10)]
    rows = quality.cascade(docs_of(docs), sample_rows=20).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in rows) == sorted((str(i), *_figures(t)) for i, t in docs)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.rejected_by is None) and not (r.base_failed and r.kept)
    assert quality.cascade(docs_of([])).count() == 0


def test_cascade_order_changes_no_verdict(docs_of):
    text = "".join(f"word{k} and more " for k in range(30))
    docs = [(1, text), (2, text.upper()), (3, text.replace(" ", "*** ")), (4, "\n".join(f"- item number {k}" for k in range(20)))]
    one = sorted(quality.cascade(docs_of(docs)).select("doc_id", "kept").collect())
    two = sorted(quality.cascade(docs_of(docs), quality.RULES[::-1]).select("doc_id", "kept").collect())
    assert one == two and [r.kept for r in one] == [True, False, False, False]


def test_exact_dedup_within_and_across_batches(spark, docs_of):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = index.ingest(docs_of([(5, "a  b"), (3, "a\tb"), (9, "c"), (1, None), (2, ""), (None, "d"), (7, "e"), (7, "e")])).collect()
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in first)
    assert got == [("1", "1", 2, True), ("2", "1", 2, False), ("3", "3", 2, True), ("5", "3", 2, False), ("7", "7", 2, False), ("7", "7", 2, True), ("9", "9", 1, True), ("None", "None", 1, True)]
    second = index.ingest(docs_of([(0, "a b"), (8, "new"), (10, "c")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in second) == [(0, 3, False), (8, 8, True), (10, 9, False)]
    assert index.rows().count() == 6
    assert index.ingest(docs_of([])).count() == 0
    for again in (exact_dedup.DigestIndex(spark, index.path), index.compacted()):
        assert again.buckets == 4 and sorted((r.doc_id, r.keep_id, r.kept) for r in again.ingest(docs_of([(4, "a b"), (11, "c")])).collect()) == [(4, 3, False), (11, 9, False)]
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, buckets=8)
    index.close()
    assert exact_dedup.DigestIndex(spark, index.path).rows().count() == 6


def test_exact_dedup_retry_of_a_batch_keeps_its_rows(spark, docs_of):
    index, rows = exact_dedup.DigestIndex(spark, buckets=2), [(2, "a"), (1, "a"), (3, "b"), (None, "c")]
    plain = lambda df: sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in df.collect())
    first = plain(index.ingest(docs_of(rows), "monday"))
    assert first == plain(index.ingest(docs_of(rows[::-1]), "monday")) and sum(k for _, _, k in first) == 3 and index.rows().count() == 3
    assert not any(k for _, _, k in plain(index.ingest(docs_of(rows), "tuesday")))


def test_exact_dedup_carries_columns_of_any_name(spark):
    rows = [(1, "a", "x", 1.5, "s"), (2, "a", "y", None, "t"), (3, None, "z", 2.5, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_id` string, sha double, `own.id` string")
    kept = exact_dedup.DigestIndex(spark).new_rows(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_digest_index_has_one_file_a_bucket_with_any_number_of_partitions(spark, docs_of, monkeypatch):
    frame = type(spark.range(0))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: dealt(self, max(n, 29) if cols and isinstance(n, int) else n, *cols))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rows = [(i, f"text {i % 400}") for i in range(500)]
    found = index.ingest(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in found) == [(i, i % 400, i < 400) for i in range(500)]
    assert index.rows().count() == 400
    assert len(index.rows().inputFiles()) == 4
    again = index.ingest(docs_of([(i, f"text {i}") for i in range(390, 410)])).collect()
    assert sorted(r["doc_id"] for r in again if r["kept"]) == list(range(400, 410))
    index.close()


PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip_and_revisits(spark):
    big = "é" * 60
    rows = [(1, "http://a", "x" * 99, ""), (2, "http://b", "x" * 99, ""), (3, None, None, ""), (4, "u\r\nX-Page-Id: 9", big, ""), (5, "u", big, ""), (None, "n", big, ""), (6, "l", "long\r\n\r\n" * 50_000, "")]
    pages = spark.createDataFrame(rows, PAGES)
    archives = warc.write_archives(pages, archive_bytes=100)
    assert warc.read_archives(archives).rdd.getNumPartitions() == archives.count() > 1
    records = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert {i: bytes(records[i].payload).decode() for i in (1, 2, 3, 4, 6)} == {1: "x" * 99, 2: "x" * 99, 3: "", 4: big, 6: rows[6][2]}
    assert records[5].record_type == records[None].record_type == "revisit" and records[5].payload is None
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolved(warc.read_archives(archives)).collect())
    assert got == sorted([("1", 99, "response", None), ("2", 99, "response", None), ("3", 0, "response", None), ("4", 120, "response", None), ("5", 120, "revisit", 4), ("None", 120, "revisit", 4), ("6", 400_000, "response", None)])
    assert warc.resolved(warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES)))).count() == 0


def test_warc_reader_finds_faults():
    good = warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert [warc.parse(x)[1] for x in warc.members([good[:10], good[10:] + good])] == [b"payload", b"payload"]
    with pytest.raises(warc.WarcError):
        list(warc.members([good[:-3]]))
    raw = next(warc.members([good]))
    with pytest.raises(warc.WarcError):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(warc.WarcError):
        warc.parse(raw[:-2])

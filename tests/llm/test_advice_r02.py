
import math
import random
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import functions as F

from placescope.llm import language_id, license_scan, minhash, suffix_dedup, toxicity


def test_a_plain_cc_by_notice_is_cc_by(docs_of):
    long = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    docs = [(1, "Licensed under CC BY 4.0"), (2, long.format("")), (3, "Licensed under CC BY-NC 4.0"), (4, long.format("-NonCommercial")), (5, "under CC BY-NC 4.0")]
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in license_scan.scan(docs_of(docs)).collect()}
    assert got == {1: ("cc-by", 1.0), 2: ("cc-by", 1.0), 3: ("cc-by-nc", 1.0), 4: ("cc-by-nc", 1.0), 5: ("cc-by-nc", 0.86)}


def _wrapped(text, width, sign):
    return "\n".join(sign + line for line in textwrap.wrap(text, width))


def test_notices_wrapped_over_lines_are_found(docs_of):
    rnd = random.Random(5)
    noise = lambda: " ".join(f"w{rnd.randrange(900)}" for _ in range(40))
    docs, want = [], {}
    for label, group in license_scan.TEMPLATES.items():
        for t in group:
            for width, sign in ((76, ""), (40, "# "), (30, " * "), (25, "// ")):
                docs.append((len(docs), f"{noise()}\n{_wrapped(t, width, sign)}\n\n{noise()}"))
                want[len(docs) - 1] = label
    spread = " word word word ".join(license_scan.TEMPLATES["bsd"][0].split()) + "\n"
    docs += [(900, spread.replace(" word", "\nword")), (901, "x " * 50_000 + _wrapped(license_scan.TEMPLATES["mpl"][0], 30, "; "))]
    got = {r.doc_id: r.labels for r in license_scan.scan(docs_of(docs)).collect()}
    assert got == want | {900: "", 901: "mpl"}


def test_license_labels_equal_brute_force_over_lines_and_windows(docs_of):
    rnd = random.Random(6)
    templates = [(label, license_scan.words(t)) for label, group in license_scan.TEMPLATES.items() for t in group]
    docs = []
    for k in range(240):
        _, w = rnd.choice(templates)
        kept = [x.decode() for x in w if rnd.random() > 0.07]
        docs.append((k, "before text\n" + "".join(x + rnd.choice([" ", " ", "\n", "\n# "]) for x in kept) + "behind\n" * 30))
    got = {r.doc_id: r.labels for r in license_scan.scan(docs_of(docs)).collect()}
    for i, text in docs:
        ws = license_scan.words(text)
        base = {label for phrase, label in license_scan.PHRASES.items() if f" {phrase} " in f" {b' '.join(ws).decode()} "}
        lines = [license_scan.words(line) for line in text.split("\n")]
        blocks = [[max([len(set(w) & set(line)) / len(set(w))]) for _, w in templates] for line in lines]
        blocks.append([max(len(set(w) & set(ws[j : j + len(w)])) / len(set(w)) for j in range(max(1, len(ws) - len(w) + 1))) for _, w in templates])
        for shares in blocks:
            held = {k: x for k, x in enumerate(shares) if x >= 0.85}
            for k, x in held.items():
                own = set(templates[k][1])
                if not any((own < set(templates[o][1]) and y >= x) or (set(templates[o][1]) < own and y > x) for o, y in held.items()):
                    base.add(templates[k][0])
        assert got[i] == ",".join(sorted(base)), text


def test_rejection_limits_come_from_all_rows(spark):
    # More rows than were sampled before; the Italian one has the largest id hash of 400.
    last = spark.range(5000, 5400).orderBy(F.xxhash64("id").desc()).first()["id"]
    docs = spark.createDataFrame([*((k, "the thing and the other thing", "en") for k in range(4200)), (last, "gli uomini della città sono felici", "it")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    limits = language_id.calibrate(docs, model)
    assert sorted(limits) == ["en", "it"] and all(0 < x < 10 for x in limits.values())
    odd = spark.createDataFrame([(1, "Жжщ ыйъ " * 9), (2, "the thing")], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in language_id.predict(odd, model, limits).collect()} == {1: True, 2: False}
    # A language that no learned row is assigned to has a limit too.
    twins = spark.createDataFrame([(k, "the thing and the other thing", lang) for k in range(9) for lang in ("en", "eo")], "doc_id long, text string, lang string")
    model = language_id.fit(twins)
    limits = language_id.calibrate(twins, model)
    assert limits["eo"] == limits["en"] < 10


def test_language_model_keeps_all_grams(spark):
    rnd = random.Random(7)
    text = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(20))
    rows = [(k, text("abcdefgh") if k % 2 else text("efghijklé𝒳"), "xx" if k % 2 else "yy") for k in range(60)]
    rows += [(100, None, "xx"), (101, "12 !", "yy"), (None, "abc", None), (5, "abc def", "stray"), (102, "жжж", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small, large = language_id.fit(docs), language_id.fit(docs, 50)
    assert isinstance(large, language_id.Tables) and sorted(small) == sorted(large) == ["stray", "xx", "yy"]
    limits, same = language_id.calibrate(docs, small), language_id.calibrate(docs, large)
    assert all(abs(limits[x] - same[x]) < 1e-3 for x in limits)
    key = lambda r: (str(r.doc_id), r.lang_pred, round(r.cross_entropy, 8), round(r.score, 8), r.rejected)
    want = sorted(map(key, language_id.predict(docs, small, limits).collect()))
    assert sorted(map(key, language_id.predict(docs, large, limits).collect())) == want
    ids = lambda model: sorted(map(str, language_id.accepted(docs, model, limits).collect()))
    assert ids(large) == ids(small) != []


def test_copies_of_one_text_are_dealt_to_several_tasks(docs_of, monkeypatch):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcd ") for _ in range(300)).encode()
    anchor, first, count, place = suffix_dedup.anchor_runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 40, 16)
    runs = [{"anchor": int(a), "shares": 15, "run": int(f << 24 | c << 12 | p)} for a, f, c, p in zip(anchor, first, count, place, strict=True)]
    kinds = pa.list_(pa.struct([("anchor", pa.int64()), ("shares", pa.int64()), ("run", pa.int64())]))
    z = zstandard.ZstdCompressor().compress(text)

    def largest(ids, lists):
        rows = [pa.array(ids, pa.int64()), pa.array([77] * len(ids), pa.int64()), pa.array([z] * len(ids), pa.binary()), pa.array(lists, kinds)]
        out = pa.Table.from_batches(suffix_dedup._contexts(40, 16)(iter([pa.RecordBatch.from_arrays(rows, names=["doc_id", "tk", "z", "runs"])])))
        return max(Counter(zip(out["anchor"].to_pylist(), out["share"].to_pylist(), strict=True)).values())

    assert largest(list(range(60)), [runs] * 60) < 20  # 60 if all copies of a run go to one task
    assert largest([5], [runs * 60]) < 20
    copies = [(k, text.decode()) for k in range(30)] + [(5, text.decode()), (None, text.decode()), (40, "x" + text.decode()[:60]), (41, "abcd")]
    monkeypatch.setattr(suffix_dedup, "SHARE", 4)
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digests(docs_of(copies), 40, 16).collect())
    assert got == sorted((str(i), *w) for (i, _), w in zip(copies, suffix_dedup.brute_force([t.encode() for _, t in copies], 40), strict=True))


def test_the_signature_estimate_loses_no_similar_pair():
    equal = 0.75 + 0.25 / 16  # of two four-bit minima, at similarity 0.75
    n = minhash.MINIMA
    lost = sum(math.comb(n, k) * equal**k * (1 - equal) ** (n - k) for k in range(minhash.LEAST_EQUAL))
    banding = 1 - (1 - (1 - 0.75**minhash.ROWS) ** minhash.HALVES) ** 2
    assert lost < 1e-6 < banding / 100


def test_toxic_words_behind_any_sign_are_hit():
    measure = toxicity.Lexicon({" trash": 5.0}).matcher()
    want = measure("you trash here")
    for sign in "“”„‘’«»‹¡¿–—…§•、。！\U0001f600 \x85\\|~!?(":
        assert measure(f"you {sign}trash{sign} here") == want and " trash" in toxicity.features(f"{sign}trash"), sign
    # Look-alikes, invisible signs and marks stay inside the word.
    assert measure("you tr4­s​h here") == want
    assert toxicity.fold("été हिन्दी").split() == ["été", "हिन्दी"]

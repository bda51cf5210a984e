"""Operators 7, 9 and 10 on held-out rows and against brute force; the pipeline stage by stage."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from placescope.llm import language_id, license_scan, suffix_dedup, toxicity

SYLLABLES = {"en": "the ing ation ow th er and is".split(), "de": "sch keit ung über ein der ie ch".split(), "fr": "eau é ment tion le qu oi aux".split()}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_language_is_found_on_held_out_rows(spark):
    rnd = random.Random(1)
    rows = [(k, prose(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.randint(4, 80)), lang) for k in range(400)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "Жжщ ыйъ " * 9, None), (None, "the ing and", "en"), (5, "der schung", "de"), (5, "der schung", "de"), (1004, "the ing ation " * 9000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    got = language_id.held_out_prediction(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    truth = {i: lang for i, _, lang in rows if i != 5}
    assert all(by[i].lang_pred == lang for i, lang in truth.items()) and not any(by[i].rejected for i in truth)
    assert {i: by[i].held_out for i in truth} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(by[i].rejected and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].rejected and by[1004].lang_pred == "en" and not by[1004].rejected and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    empty = language_id.held_out_prediction(docs.limit(0))
    assert empty.count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(prose(rnd, "en", 30), "en") for _ in range(30)], "text string, lang string")
    (orders, uniform), chars = language_id.fit(docs)["en"], sorted({c for s in SYLLABLES["en"] for c in s} | {" "})
    for context in ("   ", "the", "ing", "xyz"):
        grams = [context + c for c in [*chars, "Ω"]]
        g = [language_id._gram_hash([x[-n:] for x in grams]) for n in range(1, 5)]
        c = [language_id.np.zeros(len(grams), language_id.np.uint64), *(language_id._gram_hash([x[-n - 1 : -1] for x in grams]) for n in range(1, 4))]
        assert abs(language_id.np.exp(language_id._log_probability(orders, uniform, g, c)).sum() - 1) < 0.02


def test_toxicity_learns_beginnings_of_words_and_folds(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for k in range(900):
        text, toxic = prose(rnd, "en", rnd.randint(10, 60)), k % 6 == 0
        if toxic:
            words = text.split()
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["blorfy", "Blorfed", "gruntz", "zasko,", "zaskoid"]))
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, int(toxic), None))
    odd = [(2000, None), (2001, ""), (2002, "Вlоrfy gruntz th3 ing"), (2003, "the zask­oid and"), (None, "gruntz gruntz"), (2004, "the ing ation " * 20000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, None), (3000, None, None)], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, known).collect()}
    held = [(got[i].predicted, t) for i, t, _ in labels if got[i].held_out]
    assert len(held) > 200 and sum(p == t for p, t in held) >= 0.98 * len(held)
    assert [got[i].predicted for i in (2000, 2001, 2002, 2003, None, 2004)] == [0, 0, 1, 1, 1, 0]
    lexicon = toxicity.fit(docs, known)
    assert {"blorf", "gruntz", "zasko"} <= {e.strip()[:6].rstrip() for e in lexicon.weights} | {e.strip()[:5] for e in lexicon.weights}
    measure = toxicity.Lexicon({" trash": 5.0}).matcher()
    assert measure("a trash can here") == (0.0, 0.0) and measure("you tr4sh")[0] > 0
    assert toxicity.held_out_scores(docs.limit(0), known.limit(0)).count() == 0
    assert {r.score < 0.01 for r in toxicity.held_out_scores(docs, known.limit(0)).collect()} == {True}


def _plain_toxicity(text, lexicon):
    """Hits by naive search for every entry at every place; the same formula."""
    folded = " ".join(toxicity.fold(text).split())
    if not folded:
        return 0.0, 0.0
    folded, total = f" {folded} ", 0.0
    safe = []
    for phrase in lexicon.exceptions:
        sought = " " + " ".join(toxicity.fold(phrase).split()) + " "
        safe += [(i + 1, i + len(sought) - 1) for i in range(len(folded)) if folded.startswith(sought, i)]
    for entry, weight in lexicon.weights.items():
        for i in range(len(folded)):
            if folded.startswith(entry, i) and not any(low <= i + 1 < high for low, high in safe):
                total += weight
    return math.log1p(total), math.log1p(100 * total / (len(folded.split()) + 1))


def test_toxicity_hits_equal_naive_search():
    rnd = random.Random(31)
    lexicon = toxicity.Lexicon({" tra": 1.5, " trash ": 2.0, " clown": 4.0, " los": 0.5, " é": 3.0})
    parts = "trash tr4sh can bin clown fish clowns CLOWN class loser sore lost é ésa x-trash — … ¡trash! \u00ad th3 a".split(" ")
    measure = lexicon.matcher()
    for _ in range(1500):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "  ", ", ", "\n"]) for _ in range(rnd.randint(0, 9)))
        got, want = measure(text), _plain_toxicity(text, lexicon)
        assert all(abs(g - w) < 1e-9 for g, w in zip(got, want, strict=True)), text
        assert abs(lexicon.score(*got) - 1 / (1 + math.exp(4 - want[0] - want[1]))) < 1e-9


def _plain_entropy(texts, lang_texts):
    """Interpolated Kneser-Ney by dictionaries: mean negative log probability a character of each text."""
    def normal(t):
        return "   " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())).lstrip(" ")

    top = Counter(n[i - 3 : i + 1] for t in lang_texts for n in [normal(t)] for i in range(3, len(n)))
    levels = {4: top}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount, total, kinds = {}, {}, {}
    for n, counts in levels.items():
        n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount[n] = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
        total[n], kinds[n] = Counter(), Counter()
        for g, c in counts.items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        context = gram[:-1]
        if not total[n][context]:
            return p(gram[1:])
        return max(levels[n][gram] - discount[n], 0) / total[n][context] + discount[n] * kinds[n][context] / total[n][context] * p(gram[1:])

    out = []
    for t in texts:
        n = normal(t)
        out.append(-sum(math.log(p(n[i - 3 : i + 1])) for i in range(3, len(n))) / max(1, len(n) - 3))
    return out


def test_cross_entropies_equal_plain_kneser_ney(spark):
    rnd = random.Random(41)
    rows = [(prose(rnd, lang, rnd.randint(1, 25)) + rnd.choice(["", "!", " 12 x", "Ünï"]), lang) for lang in ("en", "de", "fr") for _ in range(25)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["The thing", "x", "Ωψ", "12 über  alles!", "the\nand", *(prose(rnd, "fr", 8) for _ in range(20))]
    got, count = language_id.cross_entropies(texts, model)
    for k, lang in enumerate(sorted(model)):
        want = _plain_entropy(texts, [t for t, x in rows if x == lang])
        assert all(abs(g - w) < 1e-9 for g, w in zip(got[:, k], want, strict=True))


def _scan(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))


def _blocks_held(ws, lines, templates):
    """What lines hold of the templates, and what groups of overlapping windows do: lists of {template: share}."""
    out = []
    for line in lines:
        own = set(line)
        out.append({k: len(own & set(t)) / len(set(t)) for k, (_, t) in enumerate(templates) if 100 * len(own & set(t)) >= 85 * len(set(t))})
    hits = []
    for k, (_, t) in enumerate(templates):
        for end in range(len(ws)):
            begin = max(0, end - len(t) + 1)
            own = [i for i in range(begin, end + 1) if ws[i] in t]
            if own and own[-1] == end and 100 * len({ws[i] for i in own}) >= 85 * len(set(t)):
                hits.append((own[0], end + 1, k, len({ws[i] for i in own}) / len(set(t))))
    reach = -1
    for low, high, k, share in sorted(hits):
        if low >= reach:
            out.append({})
        out[-1][k] = max(out[-1].get(k, 0), share)
        reach = max(reach, high)
    return out


def _license_labels(text, templates):
    """Of two held templates, one a subset of the other, the one with the greater share counts, the larger if they are equal."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = set()
    for held in _blocks_held(split(low), [split(x) for x in low.split("\n")], templates):
        for k, share in held.items():
            own = set(templates[k][1])
            beaten = False
            for o, other in held.items():
                words = set(templates[o][1])
                beaten |= own < words and other >= share
                beaten |= words < own and other > share
            if not beaten:
                found.add(templates[k][0])
    return found


def test_licenses_equal_brute_force(docs_of):
    rnd = random.Random(4)
    notices = [t for group in license_scan.TEMPLATES.values() for t in group]
    pool = [w for t in notices for w in t.split()] + ["filler", "naïve", "é", "mit license", "MIT, License.", "apache\nlicense"]
    docs = [(1, None), (2, ""), (3, "\x00\x7f"), (4, "General  PUBLIC license " * 3), (None, "mit license"), (5, "word " * 50_000 + "Apache License")]
    docs += [(100 + k, " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 60)))) for k in range(150)]
    docs += [(400 + k, "noise line\n" + " ".join(rnd.sample(t.split(), max(1, len(t.split()) - rnd.randint(0, 3)))) + "\nmore") for k, t in enumerate(notices * 4)]
    got = license_scan.scan(docs_of(docs)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted((str(i), *map(lambda x: str(x) if x is None else x, _scan(t)[:2]), *map(str, _scan(t)[2:4]), _scan(t)[4]) for i, t in docs)
    templates = [(label, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for label, group in license_scan.TEMPLATES.items() for t in group]
    by = {r.doc_id: r for r in got}
    for i, t in docs:
        if i not in (None, 5):
            assert by[i].labels == ",".join(sorted(set(filter(None, _scan(t)[4].split(","))) | _license_labels(t or "", templates))), t
    assert by[5].labels == "apache" and by[None].labels == "mit"
    assert license_scan.scan(docs_of([])).count() == 0


def test_pipeline_stages_equal_plain_python(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(k, prose(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.randint(20, 90)), lang) for k in range(120)]
    passage = prose(rnd, "en", 70)
    rows += [(200 + k, prose(rnd, "en", 60) + " " + passage + " " + prose(rnd, "en", 60), "en") for k in range(6)]
    rows += [(300 + k, rows[k][1].replace(" ", "  "), rows[k][2]) for k in range(8)]
    rows += [(400 + k, rows[k][1] + " plus", rows[k][2]) for k in range(20, 28)]
    rows += [(500, None, "en"), (501, "", None), (502, "42 !", "en"), (503, "Жжщ ыйъ " * 30, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept string, own string, kept string, component_id string, row string"
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), *"abcde") for i, t, lang in rows], schema).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(out)
        docs = steps[name] = spark.read.parquet(out)
        if name != "best_fit_packing":
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            assert {tuple(r[5:]) for r in docs.collect()} == {tuple("abcde")}
    ids = lambda name: sorted(r.doc_id for r in steps[name].collect())
    clean = [r for r in rows if r[0] < 500]
    assert ids("language_id") == [i for i, _, _ in clean]
    assert ids("exact_dedup") == sorted(i for i, _, _ in clean if not 300 <= i < 400)
    assert ids("minhash_near_dedup") == ids("suffix_dedup") == sorted(i for i, _, _ in clean if i < 300)
    left = sorted((r.doc_id, r.text) for r in steps["minhash_near_dedup"].collect())
    want = suffix_dedup.brute_force([t.encode() for _, t in left], 200)
    cut = {r.doc_id: r for r in steps["suffix_dedup"].collect()}
    assert all(len(t.encode()) - len(cut[i].text.encode()) in range(w[0], w[0] + 7 * max(1, w[1])) and cut[i].n_chars == len(cut[i].text) for (i, t), w in zip(left, want, strict=True))
    assert all(want[k][0] > 200 for k, (i, _) in enumerate(left) if 200 <= i < 300)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in steps["best_fit_packing"].collect():
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(tok.encode(cut[i].text, add_special_tokens=False).ids) + 1 for i in cut}
    assert corpus_pipeline.run(spark, folder).count() == steps["best_fit_packing"].count()

"""Operators 2 and 4 and the component search against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from placescope.llm import minhash, suffix_dedup
from placescope.llm.components import LEAST_TASKS, components


def _near(rows):
    def shingles(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return sorted((str(i), len(sets[k]), str(smallest.get(find(k))), i == smallest.get(find(k))) for k, (i, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(docs_of):
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "Same Few"), (904, "same  few"), (905, "few same"), (None, "w1 " * 12), (906, "W1 " * 12), (907, "w1 " * 30)]
    for group in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 300))]
        for copy in range(rnd.randint(1, 12)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 40))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((group * 20 + copy, " ".join(words)))
    rows += [(0, "another text with an id that stands twice"), (0, rows[9][1])]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs_of(rows)).collect())
    assert got == _near(rows)
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_pair_join_is_compiled_not_interpreted(spark, docs_of, monkeypatch, capsys):
    """The JVM compiles no method of more than 8,000 bytes; the condition of the pair join was in one of 12,166."""
    joins, across = [], minhash._across
    monkeypatch.setattr(minhash, "_across", lambda *a: joins.append(across(*a)) or joins[-1])
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(300)}" for _ in range(80)]
    rows = [(k, " ".join(w if rnd.random() > 0.03 else f"x{rnd.randrange(99)}" for w in base)) for k in range(30)]
    assert minhash.near_duplicates(docs_of(rows)).count() == 30
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        joins[0].select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8_000


def test_bitmaps_bound_what_sets_have_in_common():
    rng = np.random.default_rng(3)
    for size in (1, 40, 300, 900, 5000):
        for share in (0.0, 0.5, 0.75, 0.9, 1.0):
            common = rng.integers(0, 2**64, size=int(size * share), dtype=np.uint64)
            pair = [np.unique(np.concatenate([common, rng.integers(0, 2**64, size=size - len(common), dtype=np.uint64)])) for _ in range(2)]
            maps = [minhash.bitmap(s).view(np.uint64) for s in pair]
            fell = [len(s) - int(np.bitwise_count(m).sum()) for s, m in zip(pair, maps, strict=True)]
            bound = int(np.bitwise_count(maps[0] & maps[1]).sum()) + min(fell)
            assert len(np.intersect1d(*pair)) <= bound
            if size == 300 and share <= 0.75:  # a similarity of 0.6 is recognised as too low
                assert 175 * bound < 75 * (len(pair[0]) + len(pair[1]))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 180)] + [(5, k) for k in range(200, 230)] + [(7, 7), (9, 8), (9, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 181)} | {k: 5 for k in [5, *range(200, 230)]} | {9: 8, 8: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _check(rows, df, length):
    want = suffix_dedup.brute_force([(t or "").encode() for _, t in rows], length)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())
    assert got == sorted((str(i), len((t or "").encode()), *w) for (i, t), w in zip(rows, want, strict=True))


def test_repeats_equal_brute_force(docs_of):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    shared = [text(k) for k in (199, 200, 201, 350, 900)]
    rows = [(1, None), (2, ""), (3, "x"), (4, "x" * 700), (5, "ab" * 150), (6, shared[1]), (7, shared[0]), (8, shared[0] + "q"), (9, shared[3]), (9, shared[3]), (None, shared[4][:500])]
    rows += [(20 + k, text(rnd.randint(0, 300)) + rnd.choice(shared) + text(rnd.randint(0, 300)) + rnd.choice(shared)[rnd.randint(0, 50) :]) for k in range(25)]
    _check(rows, suffix_dedup.removal_digests(docs_of(rows)), 200)
    assert suffix_dedup.removal_digests(docs_of([])).count() == 0


def test_repeats_with_dealt_anchors_and_long_texts(docs_of, monkeypatch):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    passage = text(120)
    rows = [(k, text(rnd.randint(20, 90)) + passage[rnd.randint(0, 20) :] + text(50)) for k in range(60)] + [(100, text(900) + passage + text(700))]
    monkeypatch.setattr(suffix_dedup, "SHARE", 4)
    _check(rows, suffix_dedup.removal_digests(docs_of(rows), 40, 16), 40)


def test_long_text_in_parts_gives_the_same_windows(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.anchor_runs(data, np.array([0, 5000]), 200, 72)
    assert whole[2].sum() == 5000 - 199
    cover = np.concatenate([np.arange(s, s + n) for s, n in zip(whole[1], whole[2])])
    assert (cover == np.arange(5000 - 199)).all()


def test_repeat_removal_steps_are_bounded_by_windows(monkeypatch):
    """A batch with many windows is sorted in steps; groups stay whole and none is lost."""
    rows = 3000
    anchor = np.repeat(np.arange(rows // 2), 2)
    part = [bytes([k % 251]) * 256 for k in anchor.tolist()]
    columns = [pa.array(np.arange(rows)), pa.array(np.zeros(rows, np.int64)), pa.array(anchor), pa.array(np.ones(rows, np.int64)), pa.array(np.full(rows, 129 << 12 | 128)), pa.array(np.zeros(rows, np.int64)), pa.array(part, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "anchor", "shares", "run", "share", "part"])
    whole = pa.Table.from_batches(list(suffix_dedup.sorted_windows(pa.Table.from_batches([batch]), 200, 72)))
    steps, plain = [], suffix_dedup.sorted_windows

    def noted(group, length, gram):
        steps.append((group.num_rows, set(group["anchor"].to_pylist())))
        return plain(group, length, gram)

    monkeypatch.setattr(suffix_dedup, "sorted_windows", noted)
    got = pa.Table.from_batches(list(suffix_dedup._radix(200, 72)(iter([batch.slice(0, 0), batch]))))
    assert got.sort_by("doc_id").equals(whole.sort_by("doc_id")) and got.num_rows == rows
    assert sum(n for n, _ in steps) == rows and sum(len(a) for _, a in steps) == rows // 2
    assert max(n for n, _ in steps) * 129 < 2 * suffix_dedup.STEP_WINDOWS and len(steps) > 1


def test_cleaning_takes_one_python_step_a_task(spark):
    docs = spark.createDataFrame([(1, "a" * 300, "x"), (2, "b" + "a" * 250, None), (3, None, "y")], "doc_id long, text string, lang string")
    out = suffix_dedup.cleaned(docs)
    assert sorted((r.doc_id, r.text, r.lang) for r in out.filter("lang is not null").collect()) == [(1, "", "x"), (3, "", "y")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # texts before the join, cutting behind it


def test_packing_makes_no_rows_in_python_workers(spark):
    from placescope.llm import packing

    cut = spark.range(30).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + id % 3 as length", "id as ids_crc32")
    out = packing.pack(cut, capacity=6)
    taken = {}
    for r in out.collect():
        taken.setdefault(r.sequence_id, []).extend(range(r.offset, r.offset + r.length))
    assert len(taken) == 10 and all(sorted(places) == list(range(6)) for places in taken.values())
    assert "LogicalRDD" not in out._jdf.queryExecution().analyzed().toString()


def test_components_of_few_links_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(1000, i) for i in range(1001, 1200)] + [(7, 7)]
        found = components(spark.createDataFrame(links, "a long, b long"))
        files = found.inputFiles()
        rows = sorted(tuple(r) for r in found.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == sorted([(i, i - i % 50) for i in range(300)] + [(i, 1000) for i in range(1000, 1200)])
    assert len(files) <= LEAST_TASKS


def test_a_component_step_is_few_jobs_and_broadcasts_nothing(spark):
    def job(name):
        spark.sparkContext.setJobGroup(name, name)
        spark.sparkContext.parallelize([1], 1).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    links = spark.createDataFrame([(1000, i) for i in range(1001, 1100)] + [(1, 2), (2, 3), (3, 3)], "a long, b long")
    before = job("before-components")
    found = components(links)
    jobs = job("after-components") - before - 1
    assert {r.node: r.label for r in found.collect()} == {k: 1000 for k in range(1000, 1100)} | {1: 1, 2: 1, 3: 1}
    assert jobs <= 16  # 12; 24 when a step joined by broadcasts and was counted by a query of its own

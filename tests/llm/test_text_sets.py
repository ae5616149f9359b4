import random
import re
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import fingerprints, graph, jaccard
from keyloom.llm.common import written
from keyloom.sources import folders

from .conftest import ODD


def plain_classes(pairs, words, percent):
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in pairs]
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (i, _), x in zip(pairs, label, strict=True):
        k = -(2**63) if i is None else i
        least[x] = min(least.get(x, k), k)
    return sorted((str(i), len(s), str(None if least[x] == -(2**63) else least[x])) for (i, _), s, x in zip(pairs, sets, label, strict=True))


def corpus(seed, n=160):
    rnd = random.Random(seed)
    bank = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(bank) for _ in range(rnd.choice([2, 5, 11, 20, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rnd.randrange(len(w))
            w[at : at + rnd.choice([0, 1])] = [rnd.choice(bank)]
        rows.append((i * 3, " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 5, 80)])
def test_classes_match_all_pairs(docs, seed, words, percent):
    rows = corpus(seed) + [x for x in ODD if x[0] != 5]
    out = jaccard.classes(docs(rows), words, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == plain_classes(rows, words, percent)


@pytest.mark.parametrize(("seed", "words", "percent", "leaf"), [(3, 3, 90, 5), (4, 5, 80, 8), (5, 2, 80, 300)])
def test_large_blocks_lose_nothing(docs, monkeypatch, seed, words, percent, leaf):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rows = corpus(seed)
    out = jaccard.classes(docs(rows), words, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == plain_classes(rows, words, percent)


@pytest.mark.parametrize(("seed", "words", "percent"), [(6, 3, 90), (7, 5, 80), (8, 2, 80)])
def test_crowded_digests_lose_nothing(docs, monkeypatch, seed, words, percent):
    monkeypatch.setattr(jaccard, "CROWD", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = corpus(seed)
    out = jaccard.classes(docs(rows), words, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == plain_classes(rows, words, percent)


def test_shared_passages_dont_make_blocks(docs, monkeypatch):
    large, real = [], jaccard._large
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    monkeypatch.setattr(jaccard, "_large", lambda *a: large.append(1) or real(*a))
    passage = lambda i: " ".join(f"p{i}w{k}" for k in range(150))
    rows = [(i, f"{passage(i)} {passage(i + 1)}") for i in range(60)] + [(100 + i, f"{passage(i)} {passage(i + 1)} x") for i in range(0, 60, 7)]
    out = jaccard.classes(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == plain_classes(rows, 5, 80)
    assert not large  # each text shares half with the next: a chain of all


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.name() for x in map(disk.getAllBlocks().apply, range(disk.getAllBlocks().size())) if x.isShuffle()}
    before = files()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before
    assert table.count() == 7


def test_one_row_of_a_class_stays_where_doc_ids_repeat(docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text), (2, text + " x"), (2, "other words here now again and again"), (5, "other words here now again and again"), (7, text + " x")]
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs(rows)).collect()]
    assert len(kept) == 2 and {i for i, _ in kept} == {2} and len({t[:5] for _, t in kept}) == 2


def test_every_similar_pair_shares_a_digest():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for n in (5, 9, 10, 17, 40, 111, 400, 1500):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for _ in range(6):
                k = int(rng.integers(0, max(1, (100 - percent) * n // 100) + 1))
                b = np.unique(np.concatenate([a[k // 2 :], rng.integers(0, 2**63, k - k // 2, dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if len(a) and 100 * inter >= percent * (len(a) + len(b) - inter):
                    (da, _), (db, _) = jaccard.digests([a], percent), jaccard.digests([b], percent)
                    assert np.array_equal(a, b) or np.intersect1d(da, db).size, (percent, n, k)


def test_folded_points_bound_the_overlap():
    rng = np.random.default_rng(8)
    for n in (3, 100, 300, 5000, 40_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for m in (n // 2, n, 2 * n):
            b = np.unique(np.concatenate([a[: m // 2], rng.integers(0, 2**63, m, dtype=np.uint64)]))
            both = jaccard.points_of([jaccard.point(a), jaccard.point(b)])
            assert both.sum(axis=1).tolist() == [len(a), len(b)] and both.min(axis=0).sum() >= len(np.intersect1d(a, b))
            assert both.shape[1] == min(jaccard.groups_for(len(a)), jaccard.groups_for(len(b)))
    same = np.arange(300, dtype=np.uint64)  # all in one group
    assert jaccard.points_of([jaccard.point(same)]).max() == 300 and jaccard.point(same)[-1] == 4


def test_tree_bound_is_a_bound():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rng.integers(20, 60, 8)]
    own = [np.unique(np.concatenate([base[rng.integers(8)][: rng.integers(15, 60)], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for _ in range(150)]
    label = jaccard.link(own, 80)
    plain = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            inter = len(np.intersect1d(own[i], own[j]))
            if 100 * inter >= 80 * (len(own[i]) + len(own[j]) - inter):
                plain = [plain[j] if x == plain[i] else x for x in plain]
    same = lambda x: [[a == b for a in x] for b in x]
    assert same(label.tolist()) == same(plain)


def test_keep_one(docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(4, text), (2, text), (9, text + " x"), (5, "other words here now again"), (5, "other words here now again"), (6, None), (7, "")]
    kept = jaccard.keep_one(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7] and kept.columns == docs([]).columns
    assert jaccard.keep_one(docs([])).count() == 0 and jaccard.classes(docs([])).count() == 0


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(20)] + [(500, x) for x in range(501, 520)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for e in edges for x in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_go_on_while_a_node_has_two_roots(spark):
    edges = [(1, 4), (2, 5), (3, 4), (3, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 6), 1)
    rnd = random.Random(8)
    edges = [(100 * g + a, 100 * g + b) for g in range(60) for ids in [rnd.sample(range(100), 8)] for a, b in zip(ids, ids[1:], strict=False)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    least = {g: min(min(e) for e in edges if e[0] // 100 == g) for g in range(60)}
    assert len(got) == 480 and all(r.component == least[r.node // 100] for r in got)


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_few_edges_are_joined_without_rounds(spark, monkeypatch, kind):
    rnd = random.Random(9)
    node = {"long": lambda x: x - 200, "binary": lambda x: bytes([x % 7 * 40, x // 7, 0][: 2 + x % 2])}[kind]
    pairs = {(x, x + 1) for x in range(150)} | {tuple(rnd.sample(range(160, 400), 2)) for _ in range(160)}
    pairs = {tuple(sorted((node(x), node(y)))) for x, y in pairs if node(x) != node(y)}
    edges, tables = written(spark.createDataFrame(sorted(pairs), f"a {kind}, b {kind}").repartition(5)), []
    monkeypatch.setattr(graph, "written", lambda df: tables.append(1) or written(df))
    few = sorted(map(tuple, graph.components(edges, clean=True).collect()))
    assert not tables  # each round of stars writes at least two
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for x, y in pairs:
            least[x] = least[y] = min(least[x], least[y])
    assert few == sorted(least.items())
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(map(tuple, graph.components(edges, clean=True).collect())) == few
    assert tables


def test_few_edges_by_stars(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    test_components(spark)
    test_components_go_on_while_a_node_has_two_roots(spark)


def test_a_large_block_takes_few_tables(spark, docs, monkeypatch):
    """However long the paths of links are: 11 before the leaves, 6 for each of two rounds of them, 2 after."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    pairs, at = corpus(1), folders.made()
    got = jaccard.classes(docs(pairs), 3, 80)
    assert folders.made() - at <= 25
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == plain_classes(pairs, 3, 80)


def test_sketches():
    rng = np.random.default_rng(7)
    a, b = rng.bytes(6000), rng.bytes(3000)
    x, y, both = fingerprints.sketch(a), fingerprints.sketch(a[:3000] + b), fingerprints.sketch(a + b)
    assert abs(fingerprints.resemblance(x, y) - 1 / 3) < 0.15 and fingerprints.resemblance(x, x) == 1
    assert abs(fingerprints.distinct(x) / 5989 - 1) < 0.3 and abs(fingerprints.containment(x, both) - 1) < 0.25
    merged = fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(a[-11:] + b))
    assert np.array_equal(merged, both)
    for n in (0, 1, 5, 12, 13, 200):
        raw = a[:n]
        plain = {raw[i : i + 12] for i in range(max(1, n - 11))} if n else set()
        assert len(fingerprints.sketch(raw, k=10**6)) == len(plain)
    assert np.array_equal(fingerprints.load(fingerprints.dump(x)), x)


def test_edited_pairs(docs):
    import hashlib

    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(400)))) for i in rnd.sample(range(1000), 50)] + [x for x in ODD if x[0] not in (5, None)]
    rows = list({i: t for i, t in rows}.items())
    ordered = sorted(rows)
    want = {}
    for (i, t), (_, after) in pairwise([*ordered, ordered[0]]):
        t, after = t or "", after or ""
        n = len(t) // 4
        want[i] = (len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())
    out = {r.doc_id: r for r in fingerprints.edited_pairs(docs(rows)).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in out.items()} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())
    single = fingerprints.edited_pairs(docs([(1, "abcd")])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and single.near_next == 1
    assert fingerprints.edited_pairs(docs([])).count() == 0 and fingerprints.edited_pairs(docs(ODD)).count() == len(ODD)
    assert fingerprints.fingerprint(docs(ODD)).count() == len(ODD)

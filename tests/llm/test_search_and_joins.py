import random
import re

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from velotrace.llm import jaccard, knn
from velotrace.llm.common import components


@pytest.mark.parametrize("queries,chunk,scored,enough", [(4096, 1 << 20, 256, 8), (2, 96, 4, 1)])
def test_top_k_against_all_pairs(spark, monkeypatch, queries, chunk, scored, enough):
    for name, value in (("QUERIES", queries), ("CHUNK", chunk), ("SCORED", scored), ("ENOUGH", enough)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 6)).astype(np.float32)
    vectors[100:160] = vectors[100]  # a common vector, so scores tie
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(400, None, 1), (500, [1.0, None], 1), (600, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 1), (800, [], 1), (900, [2.0, 3.0], 1), (None, [1.0] * 6, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in knn.search(d, every=20).collect())
    whole = {i: np.pad(np.floor(1024 * np.array(v, np.float64)), (0, 6 - len(v))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert knn.search(spark.createDataFrame([], kind)).count() == 0
    assert knn.search(spark.createDataFrame([(1, [1.0])], kind)).count() == 0
    got = knn.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1024 * 2048)]


def test_large_numbers_are_exact():
    q, x = np.array([[2**40, 3]]), np.array([[2**20, 5], [1, 2**61]])
    assert knn.scores(q, x).tolist() == [[2**60 + 15, 2**40 + 3 * 2**61]]
    with pytest.raises(OverflowError):
        knn.scores(np.array([[2**40, 3]]), np.array([[2**40, 3]]))


def test_repeated_ids_lose_no_neighbour(spark):
    """Many rows under a query's own id lie nearest to it; others must still be found."""
    rows = [(0, [10.0, 0.0])] * 30 + [(0, [9.9, 0.1])] * 30 + [(i, [9.0 - i / 100, float(i % 3)]) for i in range(1, 40)] + [(i, [-5.0, float(i)]) for i in range(40, 90)]
    got = [tuple(r) for r in knn.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()]
    whole = [(i, np.floor(1024 * np.array(v))) for i, v in rows]
    both = {tuple(v) for i, v in whole if i == 0}
    want = sorted((-int(np.array(q) @ x), i) for q in both for i, x in whole if i != 0)[:10]
    assert sorted(got) == [(0, r, i, -s) for r, (s, i) in enumerate(want, 1)]


def test_clustered_vectors_are_searched_in_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 8)) * 10
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 0.1).astype(np.float32)
    d = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)
    sent = []
    monkeypatch.setattr(knn, "met", lambda placed, routed, c, k, met=knn.met: sent.append((routed.count(), int((c.rows > 0).sum()))) or met(placed, routed, c, k))
    got = sorted(tuple(r) for r in knn.search(d).collect())
    assert sum(n for n, _ in sent) < 0.5 * 40 * sent[0][1]  # of 40 queries and all cells
    whole = np.floor(1024 * vectors.astype(np.float64))
    for q in range(0, 4000, 100):
        want = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:10]
        assert [(i, s) for x, _, i, s in got if x == q] == [(i, -s) for s, i in want]


def plain_components(texts, words=3, num=90):
    """By all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = set(zip(*[w[j:] for j in range(words)])) if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, texts, **costs):
    d = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, n string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d, **costs).collect()}
    assert got == plain_components(texts)


def test_odd_texts(spark, odd_texts):
    check(spark, {1000 - 7 * i: t for i, t in enumerate(odd_texts)})


@pytest.mark.parametrize(
    "docs,elements,scan,few,costs", [(800, 1_000_000, 100_000, 500_000, {}), (12, 3000, 50, 500_000, {"matches": 3, "calls": 2}), (12, 3000, 50, 0, {"matches": 16, "calls": 4}), (800, 1_000_000, 10, 0, {"matches": 1, "calls": 1})]
)
def test_near_copies_and_passages(spark, monkeypatch, docs, elements, scan, few, costs):
    """Chains of copies, a passage in most documents, and blocks that cut groups; elements costly and cheap, few and many."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", docs)
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", elements)
    monkeypatch.setattr(jaccard, "SCAN", scan)
    monkeypatch.setattr(jaccard, "PART", scan * 20)
    for name in ("HELD_TOKENS", "BROADCAST_IDS"):
        monkeypatch.setattr(jaccard, name, few)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    texts, n = {}, 0
    for _ in range(8):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(rng.choice([1, 3, 14])):
            at = rng.randrange(len(words))
            words = [*words[:at], rng.choice(vocabulary), *words[at + rng.randint(0, 1) :]]
            texts[n] = " ".join(words) + (" " + passage if rng.random() < 0.6 else "")
            n += 1
    for _ in range(20):
        texts[n] = " ".join(rng.choice(vocabulary) for _ in range(20)) + " " + passage
        texts[n + 1] = texts[n].upper()
        n += 2
    check(spark, texts, **costs)


@pytest.mark.parametrize("held", [500_000, 0])
def test_ids_and_elements_make_no_objects_on_the_driver(spark, monkeypatch, held):
    """Copies, near copies and a passage that calls nobody: ids and costly elements come as arrays or not at all."""
    monkeypatch.setattr(jaccard, "HELD_IDS", held)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", held)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = {i: " ".join(f"w{i // 3}x{j}" for j in range(60)) + (" end" if i % 3 else "") for i in range(9)}
    texts |= {100 + i: f"{passage} a{i} b{i}" for i in range(30)}
    fetched, collect = [], DataFrame.collect
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: fetched.append(collect(self)) or fetched[-1])
        d = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert max(map(len, fetched)) <= 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in d.collect()} == plain_components(texts)


def test_rows_without_an_id_and_repeated_ids(spark, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "a b c d"), (3, "x y z"), (5, "x y z"), (9, None)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == sorted([(5, 2, 3), (5, 2, 3), (-1, 2, None), (7, 2, 3), (3, 1, 3), (5, 1, 3), (9, 0, 9)])


def test_texts_of_one_id_link_by_either(spark):
    """Two texts of one size under one id, each with a near copy under another."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(5, a), (5, b), (9, [*b, "more"]), (11, [*a, "more"]), (5, a), (20, ["c", *b])]
    got = jaccard.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(5, 58, 5)] * 3 + [(9, 59, 5), (11, 59, 5), (20, 59, 5)]


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        parent[max(u, v)] = min(u, v)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(find(n) == r for n, r in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}

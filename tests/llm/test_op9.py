import random

import pytest

from siltstone.llm import graph
from siltstone.llm import op9_near_dedup as op9


def brute(docs, n, percent):
    words = lambda t: t.encode().lower().split() if t else []
    sets, parent = {}, {}
    for i, (k, t) in enumerate(docs):
        w = words(t)
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        if k is not None:
            parent.setdefault(k, k)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i] and docs[i][0] is not None]
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(docs[ids[a]][0]), top(docs[ids[b]][0])
                parent[max(p, q)] = min(p, q)
    return sorted(((k, len(sets[i]), top(k) if k is not None and sets[i] else k) for i, (k, _) in enumerate(docs)), key=repr)


def found(df, **options):
    got = op9.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize("n,percent,block", [(3, 85, 256), (5, 80, 8)])
def test_against_all_pairs(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(op9, "BLOCK", block)
    rng = random.Random(n)
    vocab = [f"w{k}" for k in range(400)]
    docs = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 4, 8, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 14)):
            own = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            docs.append([len(docs), " ".join(own) if rng.random() < 0.7 else "  ".join(own).upper()])
    common = " ".join(rng.choice(vocab) for _ in range(60))
    docs += [[len(docs) + k, common + " " + " ".join(rng.choice(vocab) for _ in range(60))] for k in range(60)]
    docs += [[5000, None], [5001, ""], [5002, " \t "], [5003, None], [5004, "one"], [5005, "ONE"], [5006, "one two"]]
    docs = [tuple(x) for x in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rep", "'k' as key").repartition(4)
    assert found(df, n=n, threshold=percent / 100) == brute(docs, n, percent)


def test_repeated_and_null_ids(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c D e f"), (None, "a b c d e f"), (3, "x y z")]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 1, 3)], key=repr)
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op9.op9_near_dedup(spark, sf)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute(docs, 3, 85)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)] + [(200 + k, 199) for k in range(20)] + [(7, 7), (500, 500), (101, 100)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    least = {x: x for a, b in pairs if a != b for x in (a, b)}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert sorted(map(tuple, graph.components(edges).collect())) == sorted(least.items())
    assert graph.components(edges.limit(0)).collect() == []


def test_few_edges_take_few_stages(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("few edges", "")
    graph.components(edges).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 8

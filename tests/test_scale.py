"""What keeps the search and its measures in proportion to the input: no rows for pairs, passes, one count of terms."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.operators import lexical
from siltstone.operators import metrics as m
from siltstone.operators.best import Best
from siltstone.operators.lexical import B, EPSILON, K1, bm25


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def brute(queries, scoped, docs, k):
    """query_id, vector_id, score and rank by the definition."""
    words = {i: text.split() for i, text in docs}
    out = []
    for q, s, text in queries:
        inside = sorted(v for x, v in scoped if x == s)
        n = Counter(t for v in inside for t in set(words[v]))
        raw = {t: math.log(len(inside) - c + 0.5) - math.log(c + 0.5) for t, c in n.items()}
        mean = sum(raw.values()) / max(len(raw), 1)
        avgdl = sum(len(words[v]) for v in inside) / max(len(inside), 1)
        score = {v: 0.0 for v in inside}
        for t, times in Counter(text.split()).items():
            for v in inside:
                tf = words[v].count(t)
                if tf:
                    score[v] += times * (raw[t] if raw[t] >= 0 else EPSILON * mean) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[v]) / avgdl))
        best = sorted((-round(x, 6), v) for v, x in score.items())[:k]
        out += [(q, v, -x + 0.0, r + 1) for r, (x, v) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    docs = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * r.choice((1, 1, 2)) for _ in range(r.randrange(25)))) for i in range(1, 300)]
    scoped = [("all", i) for i, _ in docs] + [("even", i) for i, _ in docs if i % 2 == 0] + [("third", i) for i, _ in docs if i % 3 == 0]
    queries = [(f"q{i}", ("all", "even", "third", "none")[i % 4], " ".join(r.choice("abcdefghijklmnop") for _ in range(i % 7))) for i in range(90)]
    return docs, scoped, queries


@pytest.mark.parametrize("pairs,block", [(1 << 17, 64), (100, 5)])
def test_bm25_against_the_definition(spark, corpus, monkeypatch, pairs, block):
    docs, scoped, queries = corpus
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "QUERIES", block)
    monkeypatch.setattr(lexical, "ROWS", 50 if block == 5 else lexical.ROWS)
    d, s = spark.createDataFrame(docs, "vector_id long, text string"), spark.createDataFrame(scoped, "scope_id string, vector_id long")
    found = bm25(spark.createDataFrame(queries, "query_id string, scope_id string, query string"), s, d, 10)
    got = sorted((r.query_id, r.vector_id, round(r.score_lexical, 6) + 0.0, r.rank_lexical) for r in found.collect())
    assert got == brute(queries, scoped, docs, 10)


def test_bm25_has_no_rows_for_pairs(spark, corpus):
    docs, scoped, queries = corpus
    found = bm25(spark.createDataFrame(queries, "query_id string, scope_id string, query string"), spark.createDataFrame(scoped, "scope_id string, vector_id long"), spark.createDataFrame(docs, "vector_id long, text string"), 10)
    assert "Join" not in plan(found) and "Generate" not in plan(found)


def test_best_drops_ties_with_larger_ids():
    best = Best(1, 2)
    best.room = 3
    for first in range(0, 40, 4):
        best.add(0, np.arange(first, first + 4), np.zeros((4, 1)))
        assert best.held <= 4
    best.add(0, np.array([-1]), np.zeros((1, 1)))
    assert list(best.cut()[1]) == [-1, 0]


def test_term_statistics(spark, tmp_path):
    rows = [(1, "a b a"), (2, "b"), (3, None), (4, ""), (5, "?!"), (6, "c c"), (6, "c c c"), (None, "d a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = {r.term: (r.df, r.cf) for r in catalog.term_statistics(spark, f"{tmp_path}/odd").collect()}
    assert got == {"a": (1, 3), "b": (2, 2), "c": (1, 5), "d": (0, 1)}
    spark.createDataFrame(rows[:6], "doc_id long, text string").write.parquet(f"{tmp_path}/plain/documents.parquet")
    found = catalog.term_statistics(spark, f"{tmp_path}/plain")
    assert {r.term: (r.df, r.cf) for r in found.collect()} == {"a": (1, 2), "b": (2, 2), "c": (1, 2)}
    assert "Generate" not in plan(found)  # a batch's counts are rows, not its words


def test_measures_with_shared_sets(spark):
    q = spark.createDataFrame([("q", 1), ("r", 1), ("none", 2), ("unlabelled", 3), ("null", None)], "query_id string, set_id int")
    good = spark.createDataFrame([(1, "b"), (1, "c"), (1, "d"), (2, "x")], "set_id int, chunk_id string")
    r = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "d", 1), ("unlabelled", "a", 1), ("null", "b", 1)], "query_id string, chunk_id string, rank int")
    each = q.join(good.groupBy("set_id").agg(F.collect_list("chunk_id").alias("relevant")), "set_id", "left").select("query_id", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))
    shared = m.ranking_metrics(q, r, relevant=good)
    assert sorted(shared.collect()) == sorted(m.ranking_metrics(each, r).collect())
    assert {x.query_id: x.n_relevant for x in shared.collect()} == {"q": 3, "r": 3, "none": 1, "unlabelled": 0, "null": 0}


def test_sets_of_relevant_ids_are_not_copied_to_items(spark):
    assert "collect_set" not in plan(catalog.ranking_measures(spark, "/root/testdata/sf0.001"))


def test_chunks_without_vectors_need_no_join(spark, sf):
    assert "Join" not in plan(catalog.chunks(spark, sf).drop("embedding"))
    assert "Join" in plan(catalog.chunks(spark, sf))

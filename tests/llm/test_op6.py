import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import op6_exact_topk as op6
from tests.compare import assert_same


def brute(rows, k):
    x = {i: [int(np.floor(1024 * float(np.float32(c)))) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = set()
    for q in x:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x[q], x[c])), c) for c in x if c != q and len(x[c]) == len(x[q]))[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("bytes_", [32 << 20, 3000])
def test_against_all_pairs(spark, monkeypatch, bytes_):
    monkeypatch.setattr(op6, "BROADCAST", bytes_)  # 3000: some turns
    monkeypatch.setattr(op6, "CANDIDATES", 64)
    monkeypatch.setattr(op6, "QUERIES", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in np.round(rng.normal(size=40), 1)]) for i in range(0, 900, 3)]
    rows += [(1000, None), (1100, [0.5] * 39 + [None]), (1200, [float("nan")] + [0.1] * 39), (1300, [float("inf")] * 40), (None, [0.1] * 40), (1400, [0.1, 0.2]), (1402, [0.3, 0.1]), (1500, [])]
    rows += [(2000 + i, [0.25] * 40) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    got = op6.top_inner_products(df, F.col("vec_id") % 100 == 0)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == brute(rows, 10)
    assert op6.top_inner_products(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(op6.op6_exact_topk(spark, sf), op6.SQL, sf)

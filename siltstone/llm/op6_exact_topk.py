"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 1024
#: Bytes of query vectors that go to every task at once; more of them take turns.
BROADCAST = 32 << 20
#: Dimensions added to the sums at a time.
DIMS = 16
EXACT = float(2**53)


def _search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query: (query, candidate, score), exact where products fit in 53 bits.

    least: what a score must reach to be of use to each query, from blocks searched before.
    """
    order = np.argsort(c_ids, kind="stable")  # so that the first of equal scores has the smaller id
    c_ids, c = c_ids[order], c[order]
    if c.size and q.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= EXACT:
        exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T
        top = 2**63 - 1
        score = np.array([[max(-top, min(top, x)) for x in row] for row in exact], np.int64).reshape(len(q), len(c))
        found = [(i, j) for i in range(len(q)) for j in sorted((j for j in range(len(c)) if c_ids[j] != q_ids[i]), key=lambda j: (-score[i, j], c_ids[j]))[:k]]
        a = np.array(found, np.int64).reshape(-1, 2)
        return q_ids[a[:, 0]], c_ids[a[:, 1]], score[a[:, 0], a[:, 1]]
    columns = np.ascontiguousarray(c.T)  # vertical layout: a dimension is a run of memory
    steps = range(0, len(columns), DIMS)
    tail_c = {at: np.sqrt((columns[at:] ** 2).sum(0)) for at in steps}
    first = q[:, :DIMS] @ columns[:DIMS]
    out = []
    least = np.full(len(q_ids), -np.inf) if least is None else least
    for i, (own, vector) in enumerate(zip(q_ids, q)):
        alive = np.flatnonzero(c_ids != own)
        acc = first[i, alive]
        for at in steps:
            if at:
                acc = acc + vector[at : at + DIMS] @ columns[at : at + DIMS, alive]
            rest = at + DIMS
            if rest < len(columns) and (len(alive) > k or least[i] > -np.inf):
                mass = np.sqrt((vector[rest:] ** 2).sum()) * tail_c[rest][alive] * (1 + 1e-9)
                floor = max(least[i], np.partition(acc - mass, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf)
                keep = acc + mass >= floor
                alive, acc = alive[keep], acc[keep]
        best = np.lexsort((alive, -acc))[:k]
        out.append((np.full(len(best), own), c_ids[alive[best]], acc[best].astype(np.int64)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _first(query: np.ndarray, candidate: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query."""
    order = np.lexsort((candidate, -score, query))
    query, candidate, score = query[order], candidate[order], score[order]
    begin = np.flatnonzero(np.diff(query, prepend=query[:1] - 1)) if len(query) else query
    place = np.arange(len(query)) - np.repeat(begin, np.diff(begin, append=len(query)))
    keep = place < k
    return query[keep], candidate[keep], score[keep]


def top_inner_products(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each query row.

    Components become floor(scale * x) and scores are their integer inner products. Rows with a null key, or a vector
    that is null or holds a null or non-finite component, take no part; a query's own key is no candidate for it; only
    vectors of as many dimensions are compared. Ties go to the smaller key; repeated rows are candidates each, and a query
    that comes several times is asked once, by its least vector of each size. Queries go to every task, which keeps the k
    best of each and what a further candidate must reach; where they are more than BROADCAST bytes, in turns, each a pass
    over the candidates whose results are written before the next. Scores beyond a long are the nearest long.
    """
    x = F.transform(F.col(f"`{vector}`"), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    bad = F.exists(F.col(f"`{vector}`"), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), x.alias("x"), is_query.alias("q"), bad.alias("bad"))
    rows = rows.filter("id is not null and v is not null and not bad").select("id", "x", F.size("x").alias("dim"), F.coalesce("q", F.lit(False)).alias("q"))

    def scan(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {d: [(np.empty(0, np.int64),) * 3 for _ in range(0, len(ids), QUERIES)] for d, (ids, _) in held.value.items()}
            least = {d: np.full(len(ids), -np.inf) for d, (ids, _) in held.value.items()}
            for big in batches:
                for at in range(0, big.num_rows, CANDIDATES):
                    batch = big.slice(at, CANDIDATES)
                    ids, dim = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                    for d in np.unique(dim):
                        if d not in held.value:
                            continue
                        some = np.flatnonzero(dim == d)
                        x = batch.column(1).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)
                        q_ids, q = held.value[d]
                        for b in range(0, len(q_ids), QUERIES):
                            own = slice(b, b + QUERIES)
                            new = _search(q_ids[own], q[own], ids[some], x, k, least[d][own])
                            query, candidate, score = best[d][b // QUERIES] = _first(*(np.concatenate(z) for z in zip(best[d][b // QUERIES], new)), k)
                            # queries with k candidates ask of others at least the worst of these
                            name, first, n = np.unique(query, return_index=True, return_counts=True)
                            full = n == k
                            at_query = b + np.searchsorted(q_ids[own], name[full])
                            least[d][at_query] = score[first[full] + k - 1]
            for parts in best.values():
                for part in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in part], names=["query_id", "vec_id", "score"])

        return run

    def turn(asked: DataFrame) -> DataFrame:
        got = asked.sort("id", "x").toArrow()  # BROADCAST bytes at most
        dim, own = got.column("dim").to_numpy(), {}
        for d in np.unique(dim):
            t = got.filter(pa.array(dim == d))
            ids, first = np.unique(t.column("id").to_numpy(), return_index=True)  # a repeated query is asked once
            own[int(d)] = ids, t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, d)[first]
        return rows.select("id", "x", "dim").mapInArrow(scan(df.sparkSession.sparkContext.broadcast(own)), found)

    found = "query_id long, vec_id long, score long"
    asked = rows.filter("q").select("id", "x", "dim")
    there = asked.agg(F.count("*").alias("n"), F.sum("dim").alias("numbers")).first()
    # a stated query set against all rows, block by block; the smaller side, the queries, goes to the candidates
    turns = -(-8 * (there["numbers"] or 0) // BROADCAST)
    if turns <= 1:
        best = turn(asked)
    else:
        dealt = saved(asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(2 * turns))))  # so a turn's queries stay below BROADCAST, as hashes deal them
        best = reduce(DataFrame.unionByName, [saved(turn(dealt.filter(F.col("turn") == t).drop("turn"))) for t in range(2 * turns)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 10 best rows for each query; null ids, and vectors that are null or hold null
    or non-finite components, take no part; ties go to the smaller id; an empty table gives no rows."""
    return top_inner_products(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

"""Vectors: normalisation and exact top-k by inner product."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved, small
from .best import Best
from .lexical import ranked

#: Numbers of the query vectors that go to every task at once; more queries take further passes over the vectors.
NUMBERS = 1 << 22
#: Vectors of a block, and queries that meet it at a time.
ROWS, QUERIES = 4096, 256


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """v over its length plus 1e-12, in doubles."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / (n + F.lit(1e-12)))), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column) -> Column:
    """Whether a vector can be compared: not null, not empty, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad), F.lit(False))


def _pass(asked: pa.Table, kind: str, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vector_id, score_semantic: the k best rows of each task for the asked queries."""
    size = np.array([len(v) for v in asked.column("embedding").to_pylist()], np.int64)
    sides = {}
    for d in np.unique(size):  # vectors meet queries of as many dimensions
        own = asked.filter(pa.array(size == d))
        sides[int(d)] = (own.column("query_id").to_pylist(), own.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))
    held = vectors.sparkSession.sparkContext.broadcast(sides)
    fields = pa.schema([pa.field("query_id", asked.schema.field("query_id").type), pa.field("vector_id", pa.int64()), pa.field("score_semantic", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(len(names), k) for d, (names, _) in held.value.items()}
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                ids, dim = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for d in np.unique(dim):
                    if d not in best:
                        continue
                    some = np.flatnonzero(dim == d)
                    v = batch.column(1).take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), d)
                    q = held.value[d][1]
                    for first in range(0, len(q), QUERIES):
                        best[d].add(first, ids[some], np.round(v @ q[first : first + QUERIES].T, 9))
        for d, (names, _) in held.value.items():
            query, ids, score = best[d].cut()
            yield pa.RecordBatch.from_arrays([pa.array(names, fields[0].type).take(pa.array(query)), pa.array(ids), pa.array(score)], schema=fields)

    return vectors.select("vector_id", "embedding", F.size("embedding").alias("dim")).mapInArrow(run, f"query_id {kind}, vector_id long, score_semantic double")


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 200) -> DataFrame:
    """query_id, vector_id, score_semantic, rank_semantic of the k best vectors by inner product for each query.

    queries: query_id, embedding; vectors: vector_id, embedding. Vectors that are null or empty, or hold a null or
    non-finite component, take no part on either side; only vectors of as many dimensions are compared. Scores are rounded
    at 9 digits, ties go to the smaller id. Queries of up to NUMBERS components go to every task; more of them are dealt
    into passes, whose k best rows are written before the next pass, so the driver holds one pass's queries at most. A task
    keeps few rows a query and reads its vectors a block at a time.
    """
    kind = dict(queries.dtypes)["query_id"]
    asked = queries.filter(usable(F.col("embedding"))).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = vectors.filter(usable(F.col("embedding"))).select(F.col("vector_id").cast("long").alias("vector_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    numbers = asked.agg(F.sum(F.size("embedding"))).first()[0] or 0
    if numbers <= NUMBERS:
        found = _pass(asked.toArrow(), kind, good, k)
    else:
        asked = saved(asked.withColumn("size", F.size("embedding").cast("long")))
        w = Window.partitionBy("lane").orderBy("query_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        lanes = -(-4 * numbers // NUMBERS)  # of which each is a pass or, if hashes deal unevenly, more
        dealt = saved(asked.withColumn("lane", F.pmod(F.xxhash64("query_id"), F.lit(lanes))).withColumn("turn", F.floor(F.sum("size").over(w) / NUMBERS)))
        turns = [(r["lane"], r["turn"]) for r in dealt.select("lane", "turn").distinct().orderBy("lane", "turn").collect()]
        found = reduce(DataFrame.unionByName, [saved(_pass(dealt.filter((F.col("lane") == a) & (F.col("turn") == b)).select("query_id", "embedding").toArrow(), kind, good, k)) for a, b in turns])
    return ranked(found, "score_semantic", k, "rank_semantic")


def scoped_top_k(queries: DataFrame, vectors: DataFrame, scoped: DataFrame, k: int = 200, prefilter: bool = False) -> DataFrame:
    """The k best inside each query's scope: by default those of the 3k best overall that are in it; else of all in it.

    scoped: query_id, vector_id. With prefilter, scores are taken of every pair in the scope.
    """
    if not prefilter:
        top = saved(vector_top_k(queries, vectors, 3 * k).drop("rank_semantic"))
        inside = scoped.select("query_id", "vector_id").join(small(top.select("query_id", "vector_id")), ["query_id", "vector_id"]).distinct()  # scopes aren't shuffled
        return ranked(top.join(inside, ["query_id", "vector_id"], "left_semi"), "score_semantic", k, "rank_semantic")
    asked = queries.filter(usable(F.col("embedding"))).select("query_id", F.col("embedding").alias("q"))
    met = scoped.select("query_id", "vector_id").join(asked, "query_id").join(vectors.filter(usable(F.col("embedding"))), "vector_id").filter(F.size("q") == F.size("embedding"))
    return ranked(met.select("query_id", "vector_id", F.round(dot(F.col("q"), F.col("embedding")), 9).alias("score_semantic")), "score_semantic", k, "rank_semantic")

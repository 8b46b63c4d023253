"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import FEW
from .common import saved


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Links every neighbour of a node that is above it (small: below it, and itself) to the least of its neighbourhood."""
    both = edges.select("a", "b") if small else edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.join(least, "a")
    out = linked.select(F.col("b").alias("x"), F.col("m").alias("y")) if small else linked.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    if small:
        out = out.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of the nodes of few edges, whose tree hangs from its least node."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = (top(above.setdefault(z, z)) for z in (a, b))
            above[max(p, q)] = min(p, q)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(top, ids)), pa.int64())], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b); the component is its least node.

    At most FEW different edges are joined in one task, for each round of stars is a dozen stages that the driver has to
    plan and keep account of. With more edges, each round is written to the shared folder; the rounds end when a round
    changes nothing, told by a count and an order-free hash. Loops and repeated edges do no harm; no edges give no rows.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    if before[0] <= FEW:
        return e.coalesce(1).mapInArrow(_forest, "id long, component long")
    while before[0]:
        e = saved(_stars(_stars(e, small=False), small=True))
        now = mark(e)
        if now == before:
            break
        before = now
    nodes = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("id"), "component").distinct())

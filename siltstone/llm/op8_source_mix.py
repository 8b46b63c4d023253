"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id and text; a document's virtual finish time is the source's words
up to its end, earlier passes included, over the source's target. The mix is a global range sort by finish time, cut where
its words reach the total budget, the sum of all targets: every source is there less than a document from its target, or
above it by what the others' last documents leave.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, with_row_key

WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n and target from rows of (source, size): a row per source.

    Sources in code point order, null last, get the weights in turn. Targets share `share` of all words by weight; none
    exceeds `most` times its source's words, and what is over is shared again by weight: with sources in order of
    capacity per weight, those are full whose capacity is at most their part of what earlier ones leave, and the first that is not full sets the level.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", (F.col("budget") - before) / F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return s.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def _sized(df: DataFrame, source: str, text: str, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORDS)), F.lit(0)).cast("long")
    h = F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), h.alias("h"), *carry)


def _queued(df: DataFrame, source: str, text: str, key: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows' size and hash, `end` (the source's words up to theirs), target and passes, and the carried columns.

    Sums within a source are by hash bucket, and then over buckets, so a source of any size is spread; the buckets' number
    follows the largest source.
    """
    docs = saved(_sized(df, source, text, key, carry))
    sources = saved(source_targets(docs, weights, share, most))
    largest = sources.agg(F.max("n")).first()[0] or 1
    digits = max(1, min(8, math.ceil(math.log(max(1, largest / 500), 16))))
    docs = docs.withColumn("bucket", F.substring("h", 1, digits))
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    # buckets of a source are summed in two steps too: by leading digit, then within it
    lead = F.substring("bucket", 1, max(0, digits - 2))
    sums = sums.withColumn("lead", lead)
    tops = sums.groupBy("source", "lead").agg(F.sum("words").alias("words"))
    running = lambda part, order: F.coalesce(F.sum("words").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("source", "lead", running(["source"], "lead").alias("lead_before"))
    sums = sums.withColumn("own", running(["source", "lead"], "bucket"))
    sums = _same(sums, tops, "lead").select("source", "bucket", (F.col("own") + F.col("lead_before")).alias("before"))
    offsets = _same(sums, sources, None)
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    docs = saved(_same(docs, offsets, "bucket").withColumn("end", F.col("before") + F.col("inside") + F.col("size")).drop("before", "inside", "bucket"))
    laps = math.ceil(most)
    place = lambda lap: F.struct(((F.col("end") + F.lit(lap) * F.col("source_size")) / F.col("target")).alias("finish"), F.col("h"), F.col("doc_id"), F.col("source"), F.col("size"), F.lit(lap).alias("lap"))
    turns = docs.filter("target > 0").select(F.explode(F.array(*[place(lap) for lap in range(laps)])).alias("place")).select("place.*")
    cut = F.broadcast(_cut(turns, sources))  # one row
    taken = lambda lap: F.when((F.col("target") > 0) & (place(lap) <= F.col("cut")), 1).otherwise(0)
    return docs.join(cut, F.lit(True), "left").withColumn("passes", sum((taken(lap) for lap in range(laps)), F.lit(0)))


def _cut(turns: DataFrame, sources: DataFrame) -> DataFrame:
    """The last place of the sorted turns at which their words are within the budget; no row if there is none.

    Range partitions are added up first; a task then adds up one of them.
    """
    order = ["finish", "h", "doc_id", "source", "size", "lap"]
    ranged = saved(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    parts = parts.select("part", before.alias("before"))
    budget = sources.agg(F.floor(F.sum("target") + 1e-6).alias("budget"))
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = ranged.join(F.broadcast(parts), "part").withColumn("so_far", F.col("before") + F.sum("size").over(w))
    return so_far.join(F.broadcast(budget), F.lit(True)).filter("so_far <= budget").agg(F.max(F.struct(*order)).alias("cut")).filter("cut is not null")


def fair_mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """doc_id, size, source_size, target, passes and taken of every row; options: weights, share and most, as source_targets takes them.

    size counts words, 0 for null and empty texts; passes says how often the mix takes the whole document (at most
    ceil(most) times), taken how many words that makes. Null sources are a source; null and repeated keys are shuffled by
    their texts' hashes; equal rows follow each other, so the result doesn't depend on how the input is dealt. A source
    without words has target 0 and takes nothing. Empty tables give no rows.
    """
    docs = _queued(df, source, text, key, **options)
    return docs.select("doc_id", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, all columns, range-sorted by virtual finish time.

    Rows are told apart by their place in their files, so repeated and null keys do no harm.
    """
    keyed = with_row_key(df)
    docs = _queued(keyed, source, text, key, carry=("__file", "__row"), **options)
    laps = docs.filter("passes > 0").select("__file", "__row", "h", "end", "source_size", "target", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("lap"))
    turns = laps.select("__file", "__row", ((F.col("end") + F.col("lap") * F.col("source_size")) / F.col("target")).alias("__finish"), F.col("h").alias("__h"))
    return keyed.join(turns, ["__file", "__row"]).orderBy("__finish", "__h", "__file", "__row").select(*[F.col(f"`{c}`") for c in df.columns])


def _same(a: DataFrame, b: DataFrame, on: str | None) -> DataFrame:
    """Inner join on source, null like null, and another column; b's row is the only one of its key."""
    b = b.withColumn("__none", F.col("source").isNull()).withColumn("__source", F.coalesce("source", F.lit(""))).drop("source")
    if on:
        b = b.withColumnRenamed(on, "__on")
    match = (F.coalesce(a["source"], F.lit("")) == F.col("__source")) & (a["source"].isNull() == F.col("__none"))
    return a.join(b, match & (a[on] == F.col("__on")) if on else match).drop("__none", "__source", "__on")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; null sources are one source, null and empty texts have
    size 0, repeated rows and null ids get a row each, and no documents give no rows."""
    return fair_mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
        2.0 * CAST(source_size AS DOUBLE) AS cap, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT source, source_size, CASE WHEN level * w >= cap THEN cap ELSE
        (max(CASE WHEN NOT level * w >= cap THEN level END) OVER ()) * w END AS target FROM l),
m AS (SELECT doc_id, d.source, h, size, source_size, target, size + coalesce(sum(size) OVER
        (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
t AS (SELECT doc_id, source, h, size, lap, (upto + lap * source_size) / target AS finish FROM m, (VALUES (0), (1)) AS v(lap) WHERE target > 0),
c AS (SELECT doc_id, source, h, size, lap, sum(size) OVER (ORDER BY finish, h, doc_id NULLS FIRST, source NULLS FIRST, size, lap ROWS UNBOUNDED PRECEDING) AS so_far FROM t),
g AS (SELECT doc_id, source, h, size, lap, row_number() OVER (PARTITION BY doc_id, source, h, size, lap ORDER BY so_far) AS copy,
        CASE WHEN so_far <= (SELECT floor(sum(target) + 1e-6) FROM f) THEN size ELSE 0 END AS words FROM c),
s2 AS (SELECT doc_id, source, h, size, copy, sum(words) AS taken FROM g GROUP BY ALL),
m2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, h, size ORDER BY upto) AS copy FROM m)
SELECT m2.doc_id, m2.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM m2 LEFT JOIN s2 ON m2.doc_id IS NOT DISTINCT FROM s2.doc_id AND m2.source IS NOT DISTINCT FROM s2.source AND m2.h = s2.h AND m2.size = s2.size AND m2.copy = s2.copy
"""

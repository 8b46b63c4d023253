"""Measures of ranked results, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import small


def filter_map(text):
    """A map from JSON text that may be quoted and may use single quotes; an empty map if it can't be read."""
    t = F.trim(F.coalesce(text, F.lit("")))
    t = F.when(t.rlike("^[\"']"), F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)
    return F.coalesce(F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "map<string,string>"), F.create_map().cast("map<string,string>"))


def relevant_ids(text):
    """Distinct parts of a piped list, untrimmed; none for null and empty texts."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(text, "\\|")))


def ranking_metrics(queries: DataFrame, results: DataFrame, k: int = 10, relevant: DataFrame | None = None) -> DataFrame:
    """query_id, n_relevant, n_retrieved, precision, recall, rr, ap for each query, failed ones (no results) included.

    queries: query_id, relevant (array of distinct chunk ids); results: query_id, chunk_id, rank. Precision divides by k even
    if fewer rows came; recall and ap are 0 without relevant ids; rr looks at the whole list.
    Where queries share sets of relevant ids, these are given as `relevant` (set_id, chunk_id, distinct) and queries hold a
    set_id instead: no set is then copied to its queries, and of its ids only those among the results are looked at.
    """
    if relevant is None:
        asked = queries.select("query_id", F.size("relevant").alias("n"))
        good = queries.select("query_id", F.explode(F.array_distinct("relevant")).alias("chunk_id")).withColumn("hit", F.lit(1))
    else:
        asked = queries.join(relevant.groupBy("set_id").agg(F.count("*").alias("n")), "set_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
        met = queries.select("query_id", "set_id").join(results.select("query_id", "chunk_id").distinct(), "query_id")
        good = relevant.join(small(met), ["set_id", "chunk_id"]).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    r = asked.join(results.select("query_id", "chunk_id", "rank"), "query_id", "left")
    r = r.join(good, ["query_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    r = r.withColumn("so_far", F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    g = r.groupBy("query_id").agg(
        F.first("n").cast("long").alias("n_relevant"), F.count("rank").alias("n_retrieved"), F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("sum_p"),
    )
    some = F.col("n_relevant") > 0
    return g.select(
        "query_id", "n_relevant", "n_retrieved", (F.round(F.col("hits") / k, 9) if k else F.lit(0.0)).alias("precision"), F.round(F.when(some, F.col("hits") / F.col("n_relevant")).otherwise(0.0), 9).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("rr"), F.round(F.when(some, F.col("sum_p") / F.col("n_relevant")).otherwise(0.0), 9).alias("ap"),
    )


def summary(metrics: DataFrame, by: str = "intent_type") -> DataFrame:
    """Means and medians of the measures over all queries and by type, in one pass by grouping sets; `level` tells which."""
    names = ("precision", "recall", "rr", "ap")
    return metrics.rollup(by).agg(
        F.grouping(by).cast("int").alias("g"), F.count("*").alias("num_queries"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names], *[F.round(F.median(c), 6).alias(f"median_{c}") for c in names[:3]]
    ).select(F.when(F.col("g") == 1, "overall").otherwise("intent").alias("level"), by, "num_queries", *[f"mean_{c}" for c in names], *[f"median_{c}" for c in names[:3]])


def score_stats(results: DataFrame) -> DataFrame:
    """Per query: count, spread and best of the final scores, distinct patients and drugs, span of days, means of components."""
    day = F.to_date("note_date")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return results.groupBy("query_id").agg(
        F.count("*").alias("num_retrieved"), mean("score_final", "avg_score"), F.min("score_final").alias("min_score"), F.max("score_final").alias("max_score"), F.round(F.stddev_samp("score_final"), 6).alias("score_std"),
        F.min_by("score_final", "rank").alias("top1_score"), F.countDistinct("patient_id").alias("unique_patients"), F.countDistinct("medication").alias("unique_medications"),
        F.datediff(F.max(day), F.min(day)).alias("date_range_days"), mean("score_semantic_norm", "avg_semantic_score"), mean("score_lexical_norm", "avg_lexical_score"), mean("score_ce", "avg_ce_score"),
    )


def stats_by_type(stats: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query type: queries with results, and means of their averages, counts and best scores."""
    s = stats.join(queries.select("query_id", "query_type"), "query_id")
    return s.groupBy("query_type").agg(F.count("*").alias("queries"), F.round(F.avg("avg_score"), 6).alias("avg_score"), F.round(F.avg("num_retrieved"), 6).alias("avg_results"), F.round(F.avg("top1_score"), 6).alias("avg_top1_score"))


def stats_overall(stats: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, those with results, their rate, and means over these."""
    q = queries.select("query_id").join(stats, "query_id", "left")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return q.agg(F.count("*").alias("total_queries"), F.count("num_retrieved").alias("successful_queries"), F.round(F.count("num_retrieved") / F.count("*"), 6).alias("success_rate"), mean("num_retrieved", "avg_results_per_query"), mean("avg_score", "avg_score_overall"), mean("top1_score", "avg_top1_score"), mean("avg_semantic_score", "avg_semantic_contribution"), mean("avg_lexical_score", "avg_lexical_contribution"), mean("avg_ce_score", "avg_ce_contribution"))


def heat_map(stats: DataFrame) -> DataFrame:
    """Rows of (query_id, metric, value) behind the dashboard's matrix, each value near 0..1."""
    cells = {"results": F.col("num_retrieved") / 10, "average": F.col("avg_score"), "best": F.col("top1_score"), "steadiness": 1 - F.coalesce("score_std", F.lit(0.0)), "semantic": F.col("avg_semantic_score"), "lexical": F.col("avg_lexical_score"), "reranker": F.col("avg_ce_score")}
    return stats.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, 6).alias("value")) for k, v in cells.items()])).alias("c")).select("query_id", "c.metric", "c.value")


def score_points(results: DataFrame) -> DataFrame:
    """query_id, score: a row per result, the data behind the chart of how final scores are distributed."""
    return results.select("query_id", F.col("score_final").alias("score"))


def export_summary(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query, those without results too: rows, mean final score, and the best row's patient, drug and score."""
    r = results.groupBy("query_id").agg(F.count("*").alias("num_results"), F.round(F.avg("score_final"), 6).alias("avg_final"), F.min_by("patient_id", "rank").alias("top_patient"), F.min_by("medication", "rank").alias("top_medication"), F.min_by("score_final", "rank").alias("top_score"))
    return queries.select("query_id").join(r, "query_id", "left").withColumn("num_results", F.coalesce("num_results", F.lit(0)).cast("long"))


def type_counts(queries: DataFrame, by: str = "intent_type") -> DataFrame:
    """How many queries each type has."""
    return queries.groupBy(by).agg(F.count("*").alias("num_queries"))


def patient_summary(registry: DataFrame) -> DataFrame:
    """Per patient: rows, distinct drugs, first and last day, rows by seizure status."""
    return registry.groupBy("patient_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("medication").alias("n_medications"), F.min("note_date").alias("first_date"), F.max("note_date").alias("last_date"),
        *[F.count_if(F.col("seizure_status") == s).alias(f"n_{s}") for s in ("positive", "negative", "unknown")],
    )


def top_medications(rows: DataFrame, n: int = 10, by: str | None = None) -> DataFrame:
    """The n most frequent drugs, of each group if one is given; ties in alphabetical order."""
    keys = [by] if by else []
    counts = rows.filter("medication is not null").groupBy(*keys, "medication").agg(F.count("*").alias("n_rows"))
    if not by:
        return counts.orderBy(F.desc("n_rows"), "medication").limit(n)
    w = Window.partitionBy(by).orderBy(F.desc("n_rows"), "medication")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def registry_totals(registry: DataFrame) -> DataFrame:
    """One row: rows, distinct patients and drugs, rows with a dosage and with a frequency, rows by outcome."""
    return registry.agg(
        F.count("*").alias("n_rows"), F.countDistinct("patient_id").alias("n_patients"), F.countDistinct("medication").alias("n_medications"), F.count("medication_dosage").alias("n_dosage"), F.count("intake_times_per_day").alias("n_frequency"),
        *[F.count_if(F.col("medication_effectiveness") == s).alias(f"n_{s}") for s in ("successful", "refractory")],
    )


def index_info(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct patients, source rows and drugs, chunks with seizure information and their percentage."""
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.countDistinct("patient_id").alias("n_patients"), F.countDistinct("source_row_id").alias("n_source_rows"), F.countDistinct("medication").alias("n_medications"),
        F.count_if("has_seizure_info").alias("n_seizure"), F.round(100 * F.count_if("has_seizure_info") / F.count("*"), 6).alias("pct_seizure"),
    )

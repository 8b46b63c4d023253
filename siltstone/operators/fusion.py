"""Merging candidates of two searches, reranking, and the final weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aliases import normal, search_terms
from ..functions.text import tokens
from .lexical import ranked


def min_max(score: Column, part: Window) -> Column:
    """Between the partition's least (0) and largest (1); scores that are all the same stay as they are."""
    lo, hi = F.min(score).over(part), F.max(score).over(part)
    return F.when(lo == hi, score).otherwise((score - lo) / (hi - lo))


def merge_candidates(semantic: DataFrame, lexical: DataFrame, n: int = 100) -> DataFrame:
    """Full outer merge by query and vector; missing scores count 0 before each side is scaled; the n best by 0.6 and 0.4."""
    m = semantic.join(lexical, ["query_id", "vector_id"], "full_outer")
    w = Window.partitionBy("query_id")
    for side in ("semantic", "lexical"):
        m = m.withColumn(f"score_{side}_norm", min_max(F.coalesce(f"score_{side}", F.lit(0.0)), w))
    m = m.withColumn("score_combined_initial", F.round(0.6 * F.col("score_semantic_norm") + 0.4 * F.col("score_lexical_norm"), 9))
    return ranked(m, "score_combined_initial", n, "rank_initial")


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a trained reranker: Jaccard overlap of distinct tokens. Not a model's score."""
    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def average_rank(score: Column, part_by: str = "query_id") -> Column:
    """Rank by falling score; equal scores share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(part_by).orderBy(score.desc())) + (F.count("*").over(Window.partitionBy(part_by, score)) - 1) / 2


def rank_norm(score: Column, part_by: str = "query_id") -> Column:
    """1 for the best rank to 0 for the last; 1 if there is one row."""
    n = F.count("*").over(Window.partitionBy(part_by))
    return F.when(n == 1, F.lit(1.0)).otherwise(1 - (average_rank(score, part_by) - 1) / (n - 1))


def match_flags(df: DataFrame, target: str = "target_medication", medication: str = "medication") -> DataFrame:
    """has_target_med, and med_match_group: whether the medication is one of the target's names, letter for letter."""
    t = F.col(target)
    has = t.isNotNull() & (t != "")
    return df.withColumn("has_target_med", has).withColumn("med_match_group", F.coalesce(has & F.array_contains(search_terms(t), normal(F.col(medication))), F.lit(False)))


def fuse(df: DataFrame, w_ce: float = 0.6, w_sem: float = 0.25, w_lex: float = 0.15, topk: int = 10, boost: float = 0.2, penalty: float = 0.05) -> DataFrame:
    """Adds rank_ce, score_ce_norm, score_boosts, score_final and rank; the topk best of each query.

    score_ce null (a reranker that failed) counts 0. Boosts: 0.01 for seizure information, 0.01 for success, `boost` for the
    target's medication; another medication costs `penalty`. So a score may pass 1.
    """
    df = df.withColumn("score_ce", F.coalesce("score_ce", F.lit(0.0)))
    df = df.withColumn("rank_ce", average_rank(F.col("score_ce"))).withColumn("score_ce_norm", rank_norm(F.col("score_ce")))
    named = F.coalesce(F.trim("medication") != "", F.lit(False))
    as_number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    boosts = (
        0.01 * as_number(F.col("has_seizure_info")) + 0.01 * as_number(F.col("medication_effectiveness") == "successful") + boost * as_number(F.col("med_match_group"))
        - penalty * as_number(F.col("has_target_med") & ~F.col("med_match_group") & named)
    )
    base = w_ce * F.col("score_ce_norm") + w_sem * F.col("score_semantic_norm") + w_lex * F.col("score_lexical_norm")
    return ranked(df.withColumn("score_boosts", F.round(boosts, 9)).withColumn("score_final", F.round(base + boosts, 9)), "score_final", topk, "rank")


def audit(results: DataFrame, queries: DataFrame, counts: DataFrame, applied: DataFrame) -> DataFrame:
    """A row per query: query, intent, filters_applied, pipeline_stats and the ordered breakdown of scores."""
    scores = F.struct(F.col("score_semantic_norm").alias("semantic"), F.col("score_lexical_norm").alias("lexical"), F.col("score_ce").alias("cross_encoder"), F.col("score_boosts").alias("boosts"), F.col("score_final").alias("final"))
    about = F.struct("patient_id", "note_date", "medication", "seizure_status")
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "vector_id", scores.alias("scores"), about.alias("metadata")))).alias("score_breakdown"))
    return queries.select("query_id", "query", "intent").join(applied, "query_id", "left").join(counts, "query_id", "left").join(rows, "query_id", "left")

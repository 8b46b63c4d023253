"""Hybrid retrieval for a table of queries at once: scope, two searches, merge, rerank, fusion, registry, audit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aliases import expand
from ..functions.text import tokens
from ..operators.fusion import audit as audit_rows
from ..operators.fusion import fuse, match_flags, merge_candidates, overlap_score
from ..operators.intent import with_intent
from ..operators.lexical import bm25
from ..operators.scope import filters_applied, scope
from ..operators.vector import scoped_top_k, vector_top_k
from ..shared import saved, small

DIMENSIONS = 64


@dataclass(frozen=True)
class Settings:
    """How many candidates, how scores weigh, and what happens to a query whose filters nothing passes.

    prefilter: search vectors inside the scope instead of filtering the best of all. whole_words: names of drugs count as
    words only. unscoped_fallback: a query with an empty scope gets the best vectors of the whole corpus, filters or not;
    off by default, as it shows rows that the query's filters exclude.
    """

    topk: int = 10
    k_semantic: int = 200
    k_lexical: int = 200
    n_rerank: int = 100
    w_ce: float = 0.6
    w_sem: float = 0.25
    w_lex: float = 0.15
    prefilter: bool = False
    whole_words: bool = False
    unscoped_fallback: bool = False


@dataclass(frozen=True)
class Retrieval:
    """results: the ranked chunks; registry: those with their registry rows; audit: a row per query; scope, semantic, lexical, merged: the steps."""

    results: DataFrame
    registry: DataFrame | None
    audit: DataFrame
    scope: DataFrame
    semantic: DataFrame
    lexical: DataFrame
    merged: DataFrame


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _hashed(terms: pa.Array) -> pa.Array:
    n = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    words = terms.flatten().dictionary_encode()
    h = np.fromiter((crc32(w.encode("utf-8")) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))[words.indices.to_numpy()]
    place = np.repeat(np.arange(len(n)), n) * DIMENSIONS + h % DIMENSIONS
    v = np.bincount(place, np.where(h >> 31, 1.0, -1.0), minlength=len(n) * DIMENSIONS).reshape(len(n), DIMENSIONS)
    v = (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * DIMENSIONS), pa.array(v.ravel()))


def hash_embedding(text: Column) -> Column:
    """A stand-in for a trained encoder: signed counts of hashed tokens, of length 1. Not a model's vector."""
    return _hashed(tokens(text))


def retrieve(
    queries: DataFrame, chunks: DataFrame, registry: DataFrame | None = None, settings: Settings = Settings(),
    embed: Callable[[Column], Column] = hash_embedding, rerank: Callable[[Column, Column], Column] | None = overlap_score,
) -> Retrieval:
    """queries: query_id, query, and filter_patient_id, filter_medication, filter_date_start, filter_date_end or `embedding` if given.
    chunks: the chunk table with vector_id and embedding.

    One row or ten thousand queries are one job. Chunk texts are fetched for the reranked candidates only. With rerank
    None every candidate's score_ce is 0, as if the reranker had failed.
    """
    q = with_intent(queries, whole_words=settings.whole_words)
    if "embedding" not in q.columns:
        q = q.withColumn("embedding", embed(F.coalesce("query", F.lit(""))))
    asked = [F.coalesce(F.col(f"want_{c}"), F.lit("")) for c in ("patient_id", "medication", "date_start", "date_end")]
    q = saved(q.withColumn("scope_id", F.xxhash64(*asked)))
    kinds = q.groupBy("scope_id").agg(*[F.min(f"want_{c}").alias(f"want_{c}") for c in ("patient_id", "medication", "date_start", "date_end")])
    seen = saved(scope(kinds.withColumnRenamed("scope_id", "query_id"), chunks).withColumnRenamed("query_id", "scope_id"))
    scoped = q.select("query_id", "scope_id").join(seen, "scope_id")
    semantic = saved(scoped_top_k(q, chunks.select("vector_id", "embedding"), scoped, settings.k_semantic, settings.prefilter))
    lexical = saved(bm25(q.select("query_id", "scope_id", expand(F.col("query")).alias("query")), seen.select("scope_id", "vector_id"), chunks, settings.k_lexical, "chunk_text_full"))
    merged = saved(merge_candidates(semantic, lexical, settings.n_rerank))
    about = q.select("query_id", "query", F.col("intent.medication").alias("target_medication"))
    found = chunks.drop("embedding").join(small(merged), "vector_id").join(about, "query_id")
    found = found.withColumn("score_ce", rerank(F.col("query"), F.col("chunk_text_full")) if rerank else F.lit(0.0))
    results = fuse(match_flags(found), settings.w_ce, settings.w_sem, settings.w_lex, settings.topk).drop("query", "target_medication")
    if settings.unscoped_fallback:
        lost = q.join(seen.select("scope_id").distinct(), "scope_id", "left_anti").select("query_id", "embedding")
        best = vector_top_k(lost, chunks.select("vector_id", "embedding"), settings.topk)
        best = chunks.drop("embedding").join(small(best), "vector_id").withColumn("score_final", F.col("score_semantic")).withColumn("rank", F.col("rank_semantic"))
        results = results.unionByName(best, allowMissingColumns=True)
    results = saved(results)
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    counts = q.select("query_id")
    for df, name in ((semantic, "semantic_candidates"), (lexical, "lexical_candidates"), (merged, "merged_candidates"), (results, "final_results")):
        counts = counts.join(count(df, name), "query_id", "left")
    names = counts.columns[1:]
    counts = counts.select("query_id", F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in names]).alias("pipeline_stats"))
    flags = scoped.select("query_id", "vector_id", "date_relaxed", "medication_dropped")
    # a row per scope: queries that share one aren't joined with its chunks for this
    relaxed = saved(seen.groupBy("scope_id").agg(F.max("date_relaxed").alias("date_relaxed"), F.max("medication_dropped").alias("medication_dropped")))
    relaxed = q.select("query_id", "scope_id").join(relaxed, "scope_id")
    trail = audit_rows(results, q, counts, filters_applied(q, relaxed))
    trail = trail.join(relaxed.select("query_id", F.lit(True).alias("some")), "query_id", "left").withColumn("empty_scope", F.col("some").isNull()).drop("some")
    return Retrieval(results, None if registry is None else with_registry(results, registry), trail, flags, semantic, lexical, merged)


def with_registry(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Results with the registry row that each came from; its columns of the same name end in _registry."""
    own = registry.select(*[F.col(c).alias(f"{c}_registry" if c in results.columns else c) for c in registry.columns])
    return results.join(own, results["source_row_id"] == own["row_id"], "left")


def retrieve_one(spark: SparkSession, query: str, chunks: DataFrame, registry: DataFrame | None = None, patient_id: str | None = None, medication: str | None = None, date_start: str | None = None, date_end: str | None = None, return_audit: bool = True, settings: Settings = Settings(), **options) -> dict[str, DataFrame]:
    """results, registry and audit of a single query."""
    schema = "query_id string, query string, filter_patient_id string, filter_medication string, filter_date_start string, filter_date_end string"
    r = retrieve(spark.createDataFrame([("1", query, patient_id, medication, date_start, date_end)], schema), chunks, registry, settings, **options)
    out = {"results": r.results.orderBy("rank")}
    if r.registry is not None:
        out["registry"] = r.registry.orderBy("rank")
    return {**out, "audit": r.audit} if return_audit else out


def retrieve_simple(spark: SparkSession, query: str, chunks: DataFrame, **options) -> DataFrame:
    """The ranked chunks of a single query."""
    return retrieve_one(spark, query, chunks, **options)["results"]

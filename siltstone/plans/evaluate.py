"""Evaluation of retrieval: labelled queries give ranking measures, others give statistics of scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..shared import saved
from ..sources.charts import write_charts
from ..sources.files import write_table
from ..sources.xlsx import write_workbook
from .retrieve import Settings, retrieve


@dataclass(frozen=True)
class Evaluation:
    per_query: DataFrame
    summary: DataFrame
    results: DataFrame


def evaluate(queries: DataFrame, chunks: DataFrame, settings: Settings = Settings(), out: str | None = None, summary_out: str | None = None, **options) -> Evaluation:
    """Measures of labelled queries (query_id, query, intent_type, relevant and filter_*), and their summary.

    With `out`, writes the rows as CSV and the summary as JSON there, or the summary to `summary_out`.
    """
    results = retrieve(queries, chunks, None, settings, **options).results.select("query_id", "chunk_id", "rank", "score_final")
    per_query = saved(m.ranking_metrics(queries, results, settings.topk).join(queries.select("query_id", "query", "intent_type"), "query_id"))
    summary = m.summary(per_query)
    if out:
        listed = results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]), "|").alias("retrieved_chunks"))
        write_table(per_query.join(listed, "query_id", "left"), f"{out}/per_query.csv", "csv")
    if out or summary_out:
        write_table(summary, summary_out or f"{out}/summary.json", "json")
    return Evaluation(per_query, summary, results)


def score_report(queries: DataFrame, chunks: DataFrame, settings: Settings = Settings(), out: str | None = None, **options) -> dict[str, DataFrame]:
    """Statistics of queries without labels (query_id, query, query_type and filter_*): per query, by type, overall, matrix, export.

    With `out`, writes a workbook with a sheet for each and for each query's rows, and five charts.
    """
    results = saved(retrieve(queries, chunks, None, settings, **options).results)
    stats = saved(m.score_stats(results))
    report = {"Summary": stats.join(queries.select("query_id", "query_type"), "query_id"), "Overall": m.stats_overall(stats, queries), "By Type": m.stats_by_type(stats, queries), "Matrix": m.heat_map(stats), "Export": m.export_summary(queries, results)}
    if out:
        shown = results.select("query_id", "rank", "chunk_id", "patient_id", "note_date", "medication", "score_final", "score_semantic_norm", "score_lexical_norm", "score_ce", F.array_join("seizure_symptoms", "|").alias("symptoms"), "chunk_preview")
        each = {f"Query {r['query_id']}": shown.filter(F.col("query_id") == r["query_id"]).orderBy("rank") for r in queries.select("query_id").collect()}
        write_workbook({**report, **each}, f"{out}/report.xlsx", widths={"chunk_preview": 100})
        write_charts(stats, report["By Type"], report["Overall"], report["Matrix"], results, f"{out}/charts")
    return report

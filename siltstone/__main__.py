"""Command line: python -m siltstone registry|index|retrieve|evaluate ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.answer import answers
from .plans.build import build_index, registry_from_files, write_index
from .plans.evaluate import evaluate
from .plans.retrieve import Settings, retrieve
from .sources.files import labelled_queries, read_registry


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="siltstone")
    steps = p.add_subparsers(dest="step", required=True)
    a = steps.add_parser("registry", help="patients' files to a registry")
    a.add_argument("root")
    a.add_argument("out")
    a = steps.add_parser("index", help="a registry to chunks and vectors")
    a.add_argument("registry")
    a.add_argument("out")
    for name in ("retrieve", "evaluate"):
        a = steps.add_parser(name)
        a.add_argument("chunks")
        a.add_argument("query" if name == "retrieve" else "queries")
        a.add_argument("--topk", type=int, default=10)
        a.add_argument("--k-semantic", type=int, default=200)
        a.add_argument("--k-lexical", type=int, default=200)
        a.add_argument("--n-rerank", type=int, default=100)
        a.add_argument("--w-ce", type=float, default=0.6)
        a.add_argument("--w-sem", type=float, default=0.25)
        a.add_argument("--w-lex", type=float, default=0.15)
        a.add_argument("--prefilter", action="store_true")
        a.add_argument("--whole-words", action="store_true")
        a.add_argument("--unscoped-fallback", action="store_true")
        a.add_argument("--out")
        if name == "retrieve":
            for c in ("patient-id", "medication", "date-start", "date-end"):
                a.add_argument(f"--{c}")
            a.add_argument("--backend", default="stub")
        else:
            a.add_argument("--summary-output", help="where the summary goes as JSON, if not beside the rows")
            a.add_argument("--quiet", action="store_true", help="prints nothing")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    if a.step == "registry":
        print(f"{registry_from_files(spark, a.root, a.out).count()} rows")
        return
    if a.step == "index":
        print(f"{write_index(build_index(read_registry(spark, a.registry)), a.out).count()} chunks")
        return
    settings = Settings(a.topk, a.k_semantic, a.k_lexical, a.n_rerank, a.w_ce, a.w_sem, a.w_lex, a.prefilter, a.whole_words, a.unscoped_fallback)
    chunks = spark.read.parquet(a.chunks)
    if a.step == "evaluate":
        found = evaluate(labelled_queries(spark, a.queries), chunks, settings, a.out, a.summary_output)
        if not a.quiet:
            found.per_query.orderBy("query_id").select("query_id", "intent_type", "n_relevant", "n_retrieved", "precision", "recall", "rr", "ap", "query").show(1000, truncate=60)
            found.summary.show(1000, truncate=False)
        return
    schema = "query_id string, query string, filter_patient_id string, filter_medication string, filter_date_start string, filter_date_end string"
    q = spark.createDataFrame([("1", a.query, a.patient_id, a.medication, a.date_start, a.date_end)], schema)
    r = retrieve(q, chunks, None, settings)
    r.results.orderBy("rank").select("rank", "chunk_id", "score_final", "chunk_preview").show(a.topk)
    print(answers(r.results, q, a.backend).first()["answer"])


if __name__ == "__main__":
    main()

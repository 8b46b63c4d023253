"""A training corpus from `documents`: each stage's rows are written as Parquet and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import fold, shared_dir, table
from siltstone.llm.op1_decontaminate import drop_contaminated
from siltstone.llm.op2_toxicity import score_toxicity, train
from siltstone.llm.op5_token_files import read_token_files, write_token_files
from siltstone.llm.op8_source_mix import mixed_documents
from siltstone.llm.op9_near_dedup import first_of_groups

#: The stages take some rows out, repeat others by hash order and fit a model; SQL can't express them.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; labels are learned from the rows that op2_toxicity learns from.

    Null and empty texts stay; each row is judged by itself; columns named like the classifier's own stay as they are.
    """
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").filter(fold("doc_id", 3) != 1))
    return score_toxicity(docs, model, out=("__toxicity", "__toxic")).filter("__toxic = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the least id, null ids last. Rows without words stay; repeated rows are copies."""
    return first_of_groups(docs, n=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by itself, whatever its id."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix; null sources are one source, null and empty texts have no words."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files in doc_id order, null ids first, read back: a row per written document, repeats included."""
    return read_token_files(spark, write_token_files(docs, shared_dir(spark)))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Files of patients, registries and labelled queries, and what is written back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import filter_map, relevant_ids
from ..schema import QUERY_COLUMNS, REGISTRY, REQUIRED, require
from .xlsx import XlsxSource


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8, or as cp1252 where they aren't that; bytes that are neither become U+FFFD."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(raw).decode("cp1252", "replace")

    return content.map(one)


def patient_files(spark: SparkSession, root: str) -> DataFrame:
    """patient_id, path, content of every {root}/Patient_{id}/{id}_seizure_context.txt; a folder without that file has no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_seizure_context.txt").load(f"{root}/Patient_*")
    files = files.withColumn("patient_id", F.regexp_extract("path", r"/Patient_([^/]+)/[^/]*\z", 1))
    own = F.col("path").endswith(F.concat(F.lit("/"), F.col("patient_id"), F.lit("_seizure_context.txt")))
    return files.filter(own & (F.col("patient_id") != "")).select("patient_id", "path", decoded(F.col("content")).alias("content"))


def write_notes(notes: DataFrame, path: str) -> None:
    """A text file per note, below patient_id= and note_id= folders; notes of one day stay apart."""
    notes.select("patient_id", "note_id", F.col("note_text").alias("value")).write.mode("overwrite").partitionBy("patient_id", "note_id").option("lineSep", "\n").text(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry from Parquet; ValueError if a required column is missing."""
    return require(spark.read.parquet(path), REQUIRED)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, CSV with a header, or JSON lines."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind of table: {kind}")
    w = df.write.mode("overwrite")
    {"parquet": w.parquet, "csv": lambda p: w.option("header", True).option("escape", '"').csv(p), "json": w.json}[kind](path)


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.schema(REGISTRY).option("header", True).option("multiLine", True).option("escape", '"').csv(path), REQUIRED)


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, intent_type, filters (map), relevant (distinct chunk ids) from a .csv or .xlsx file; ValueError for others or missing columns."""
    ending = path.rpartition(".")[2].lower()
    if ending == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif ending == "xlsx":
        spark.dataSource.register(XlsxSource)
        raw = spark.read.format("xlsx").load(path)
    else:
        raise ValueError(f"unsupported file format: .{ending}")
    raw = require(raw, QUERY_COLUMNS)
    return with_filters(raw.select(
        F.col("Query_Number").cast("string").alias("query_id"), F.col("Query_Text").alias("query"), F.col("Intent_Type").alias("intent_type"), filter_map(F.col("Filters_Applied").cast("string")).alias("filters"),
        relevant_ids(F.col("Relevant_Chunk_IDs").cast("string")).alias("relevant"),
    ))


def with_filters(queries: DataFrame) -> DataFrame:
    """Adds filter_patient_id, filter_medication, filter_date_start and filter_date_end from the map `filters`."""
    for c in ("patient_id", "medication", "date_start", "date_end"):
        queries = queries.withColumn(f"filter_{c}", F.try_element_at("filters", F.lit(c)))
    return queries


def write_index_info(info: DataFrame, path: str) -> None:
    """One JSON object."""
    info.coalesce(1).write.mode("overwrite").json(path)


def read_index_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)

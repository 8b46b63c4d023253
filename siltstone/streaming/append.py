"""Notes that arrive as files go to the registry and the chunk table, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.chunk import chunk_rows, note_chunks
from ..operators.notes import build_registry, split_notes
from ..plans.retrieve import hash_embedding


def append_notes(spark: SparkSession, incoming: str, out: str, embed: Callable[[Column], Column] = hash_embedding, unicode: bool = True) -> DataStreamWriter:
    """A stream writer from Parquet files of (patient_id, content) to {out}/registry and {out}/chunks.

    A batch replaces its own batch= folder, so one that runs again after a failure leaves nothing twice. row_id counts
    inside a batch and carries its number; a full build numbers rows of all batches anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        registry = build_registry(split_notes(batch, unicode=unicode)).withColumn("row_id", F.concat_ws("-", "patient_id", F.lit(f"b{number}"), F.regexp_extract("row_id", r"(\d+)\z", 1)))
        registry.write.mode("overwrite").parquet(f"{out}/registry/batch={number}")
        registry = spark.read.parquet(f"{out}/registry/batch={number}")
        notes = note_chunks(registry).withColumn("embedding", embed(F.col("chunk_text_full")))
        chunk_rows(registry, notes).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    files = spark.readStream.schema("patient_id string, content string").parquet(incoming)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/progress")

"""Building the registry and the index of chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import OVERLAP, TARGET, chunk_rows, note_chunks
from ..operators.metrics import index_info
from ..operators.notes import build_registry, medications, split_notes
from ..schema import REQUIRED, require
from ..shared import saved
from ..sources.files import patient_files, write_index_info, write_notes, write_table
from .numbering import number_rows
from .retrieve import hash_embedding


def registry_from_files(spark: SparkSession, root: str, out: str | None = None, extract: Callable[[Column], Column] = medications, faithful_headers: bool = False) -> DataFrame:
    """The registry of all patients' files below root; with `out`, also written there with the notes (Parquet, CSV, text)."""
    notes = saved(split_notes(patient_files(spark, root), faithful_headers))
    if out:
        notes = notes.withColumn("source_text_file", F.concat(F.lit(f"{out}/notes/patient_id="), "patient_id", F.lit("/note_id="), "note_id"))
        write_notes(notes, f"{out}/notes")
    registry = saved(build_registry(notes, extract))
    if out:
        write_table(registry, f"{out}/all_patients_combined.parquet")
        write_table(registry, f"{out}/all_patients_combined.csv", "csv")
    return registry


def build_index(registry: DataFrame, embed: Callable[[Column], Column] | None = hash_embedding) -> DataFrame:
    """The chunk table with vector_id (dense, in the order of patients, rows and chunks) and embedding.

    A note is chunked and embedded once however many rows carry it. ValueError if a required column is missing.
    """
    require(registry, REQUIRED)
    notes = note_chunks(registry)
    if embed is not None:
        notes = saved(notes.withColumn("embedding", embed(F.col("chunk_text_full"))))
    rows = chunk_rows(registry, notes).withColumn("__row", F.try_to_number(F.regexp_extract("source_row_id", r"(\d+)\z", 1), F.lit("9" * 18)))
    rows = number_rows(rows, ["patient_id", "__row", "source_row_id", "chunk_index"], "vector_id").drop("__row")
    return rows.select("vector_id", *[c for c in rows.columns if c != "vector_id"])


def write_index(chunks: DataFrame, out: str, model: str = "hashed tokens") -> DataFrame:
    """Writes the chunk table and a JSON object about it; RuntimeError if there is no chunk."""
    write_table(chunks, f"{out}/chunks.parquet")
    chunks = chunks.sparkSession.read.parquet(f"{out}/chunks.parquet")
    if chunks.isEmpty():
        raise RuntimeError("no chunks to index")
    about = [F.lit(model).alias("model"), F.lit(TARGET).alias("chunk_target_chars"), F.lit(OVERLAP).alias("chunk_overlap_chars"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("built_utc"), F.lit(f"{out}/chunks.parquet").alias("index_path")]
    write_index_info(index_info(chunks).select("*", *about), f"{out}/index_info.json")
    return chunks

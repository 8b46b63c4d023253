"""Explicit schemas of the tables that the library reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The columns of the files that are exchanged, by name and order.
REGISTRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("row_id", "patient_id", "note_date", "note_id", "source_text_file", "source_date_key", "medication", "medication_dosage")]
    + [T.StructField("intake_times_per_day", T.DoubleType()), T.StructField("drug_mention_count", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("medication_effectiveness", "seizure_status", "seizure_symptoms", "route", "form", "note_text", "extraction_context")]
)
REQUIRED = ("row_id", "patient_id", "note_id", "note_date", "note_text", "medication")
QUERY_COLUMNS = ("Query_Number", "Query_Text", "Intent_Type", "Filters_Applied", "Relevant_Chunk_IDs")


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The DataFrame, if it has all the columns; else ValueError."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df

"""Overlapping chunks of note text, packed from paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

TARGET, OVERLAP, LEAST, LEAST_TEXT = 1200, 200, 200, 50


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def windows(para: Column, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """A paragraph itself, or windows of `target` characters each `target - overlap` on, if it is longer than that.

    The last full step is followed by a window of the last `overlap` characters, as in the step-by-step definition.
    """
    n, step = F.length(para), target - overlap
    full = F.ceil((n - target) / F.lit(step)).cast("int")  # index of the window that reaches the end
    starts = F.transform(F.sequence(F.lit(0), F.greatest(full, F.lit(0))), lambda i: i * step)
    pieces = F.concat(F.transform(starts, lambda s: F.substring(para, s + 1, F.lit(target))), F.array(F.substring(para, n - overlap + 1, F.lit(overlap))))
    return F.when(n <= target, F.array(para)).otherwise(F.filter(pieces, lambda x: F.length(x) >= least))


def chunks(text: Column, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Chunks of a text: paragraphs packed while they fit, long ones cut, each led by its predecessor's tail, short ones dropped.

    Null texts and those under 50 characters have none. One row at a time, whole; nothing is shuffled.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("buf"))

    def add(acc: Column, para: Column) -> Column:
        done, buf = acc["done"], acc["buf"]
        flushed = F.when(buf == "", done).otherwise(F.array_append(done, buf))
        joined = F.when(buf == "", para).otherwise(F.concat(buf, F.lit("\n\n"), para))
        return (
            F.when(F.length(para) > target, F.struct(F.concat(flushed, windows(para, target, overlap, least)).alias("done"), F.lit("").alias("buf")))
            .when(F.length(joined) <= target, F.struct(done.alias("done"), joined.alias("buf")))
            .otherwise(F.struct(flushed.alias("done"), para.alias("buf")))
        )

    packed = F.aggregate(paragraphs(text), start, add, lambda acc: F.when(acc["buf"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["buf"])))
    tail = lambda c: F.when(F.length(c) > overlap, F.substring(c, F.length(c) - overlap + 1, F.lit(overlap))).otherwise(c)
    stitch = lambda all_: F.transform(all_, lambda c, i: F.when(i == 0, c).otherwise(strip(F.concat(tail(F.get(all_, i - 1)), F.lit("\n\n"), c))))
    led = F.element_at(F.transform(F.array(packed), stitch), 1) if overlap else packed
    return F.when(F.coalesce(F.length(text), F.lit(0)) < LEAST_TEXT, empty).otherwise(F.filter(led, lambda c: F.length(c) >= least))


def split_list(text: Column, sep: str = "\\|") -> Column:
    """A separated list as an array; parts trimmed, empty ones left out; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


OPTIONAL = {"medication_dosage": "string", "intake_times_per_day": "double", "medication_effectiveness": "string", "seizure_status": "string", "seizure_symptoms": "string"}


def note_chunks(registry: DataFrame) -> DataFrame:
    """note_id, chunk_index, chunk_text_full: the chunks of each distinct note, however many rows carry it; null and empty notes have none."""
    notes = registry.filter("note_text is not null and note_text <> ''").groupBy("note_id").agg(F.min("note_text").alias("note_text"))
    return notes.select("note_id", F.posexplode(chunks(F.col("note_text"))).alias("chunk_index", "chunk_text_full"))


def chunk_rows(registry: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """A row per chunk of each registry row; absent optional columns are null.

    notes: what note_chunks gives, perhaps with further columns (such as embedding), which are kept.
    """
    for c, kind in OPTIONAL.items():
        if c not in registry.columns:
            registry = registry.withColumn(c, F.lit(None).cast(kind))
    notes = note_chunks(registry) if notes is None else notes
    more = [c for c in notes.columns if c not in ("note_id", "chunk_index", "chunk_text_full")]
    rows = registry.drop("note_text").join(notes, "note_id")
    text = F.col("chunk_text_full")
    return rows.select(
        F.concat_ws("_", "patient_id", "note_date", "row_id", F.lit("chunk"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("row_id").alias("source_row_id"), "patient_id", "note_id",
        "note_date", "chunk_index", F.length(text).alias("chunk_char_len"), F.replace(F.substring(text, 1, 240), F.lit("\n"), F.lit(" ")).alias("chunk_preview"), text, "medication",
        "medication_dosage", "intake_times_per_day", "medication_effectiveness", "seizure_status", split_list(F.col("seizure_symptoms")).alias("seizure_symptoms"),
        F.coalesce(F.col("seizure_status") == "positive", F.lit(False)).alias("has_seizure_info"), *more,
    )

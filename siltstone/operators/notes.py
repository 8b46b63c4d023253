"""From patients' files to the registry: notes, the drugs that each names, and what is said about them.

The extractor is a rule-based one of this library; a model can take its place as a function from text to the same array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import NAMES
from ..functions.text import FLAGS, clean, line_ends, nfkc, strip
from ..plans.numbering import number_rows
from ..schema import REGISTRY

HEADER = r"^FILE:\s*(.+?)\s*\|\s*DATE:\s*(\d{8})\s*$"
BEFORE, AFTER = 80, 120  # characters of context around a mention


def notes_of(content: Column, faithful_headers: bool = False, cleaned: bool = True) -> Column:
    """An array of (note_date, note_text) of a file's dated notes that have a text, in the order of the file.

    A note begins at a line `FILE: name | DATE: yyyymmdd`; that line and bars of = below it are left out. Text before the
    first such line, and notes whose date is none, are left out too; a file without such lines has no notes. Notes are cut
    apart first and cleaned then; with faithful_headers the whole file is cleaned first, which breaks a header into three
    lines of which only the first is left out. With cleaned=False texts are only stripped.
    """
    whole = clean(content) if faithful_headers and cleaned else line_ends(content)
    blocks = F.split(whole, FLAGS + f"(?={HEADER})")
    date = lambda b: F.try_to_date(F.nullif(F.regexp_extract(b, FLAGS + r"\A\s*" + HEADER, 2), F.lit("")), "yyyyMMdd")
    body = lambda b: F.regexp_replace(strip(b), r"\A[^\n]*\n?(?:[^\S\n]*=+[^\S\n]*(?:\n|\z))*", "")
    text = clean if cleaned and not faithful_headers else strip
    notes = F.transform(blocks, lambda b: F.struct(F.date_format(date(b), "yyyy-MM-dd").alias("note_date"), text(body(b)).alias("note_text")))
    return F.filter(notes, lambda n: n["note_date"].isNotNull() & (n["note_text"] != ""))


def split_notes(files: DataFrame, faithful_headers: bool = False, unicode: bool = True, cleaned: bool = True) -> DataFrame:
    """patient_id, note_idx (from 1), note_id, note_date, note_text of files given as (patient_id, content)."""
    content = F.coalesce(F.col("content"), F.lit(""))
    n = files.select("patient_id", (nfkc(content) if unicode else content).alias("content"))
    n = n.select("patient_id", F.posexplode(notes_of(F.col("content"), faithful_headers, cleaned)).alias("at", "n"))
    n = n.select("patient_id", (F.col("at") + 1).alias("note_idx"), F.col("n.note_date").alias("note_date"), F.col("n.note_text").alias("note_text"))
    return n.select("patient_id", "note_idx", F.format_string("%s_%s_%03d", "patient_id", "note_date", "note_idx").alias("note_id"), "note_date", "note_text")


_ANY_NAME = r"(?iu)\b(" + "|".join(sorted((a for names in NAMES.values() for a in names), key=lambda a: (-len(a), a))) + r")\b"
STRENGTH = r"(?iu)(\d+(?:\.\d+)?\s*(?:mg|mcg|ml|g|units?))\b"
FORM = r"(?iu)\b(tablets?|tabs?|capsules?|caps?|solution|suspension|syrup|injection|patch|drops|XR|ER)\b"
ROUTE = r"(?iu)\b(po|by mouth|oral(?:ly)?|iv|intravenous(?:ly)?|im|intramuscular(?:ly)?|sq|subcutaneous(?:ly)?|rectal(?:ly)?|topical(?:ly)?)\b"
FREQUENCY = r"(?iu)\b(once daily|once a day|twice daily|twice a day|three times daily|three times a day|four times daily|four times a day|every \d+ hours|q\d+h|bid|tid|qid|qd|qhs|at bedtime|nightly|daily|as needed|prn)\b"
DOSAGE = r"(?iu)\b((?:\d+(?:[./]\d+)?|one|two|three|four|half a|half|a)\s+(?:tablets?|tabs?|capsules?|caps?|drops?|puffs?|patch(?:es)?|teaspoons?|sprays?))\b"
DURATION = r"(?iu)\b((?:for|x)\s*\d+\s*(?:days?|weeks?|months?|years?))\b"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _word(term: Column) -> Column:
    return F.concat(F.lit(r"(?iu)\b"), term, F.lit(r"\b"))


def medications(text: Column) -> Column:
    """An array of (drug, strength, form, route, frequency, dosage, duration, context), one for each drug's name in the text, in order of first mention.

    Attributes are the first ones that follow the first mention before the sentence or the next 120 characters end.
    """

    def linked(drug: Column) -> Column:
        at = F.regexp_instr(text, _word(drug))
        start = F.greatest(at - BEFORE, F.lit(1))
        context = F.substring(text, start, at - start + F.length(drug) + AFTER)
        after = F.regexp_extract(F.substring(text, at + F.length(drug), F.lit(AFTER)), r"(?s)\A(.*?)(?:\.\s|\n|\z)", 1)
        return F.struct(
            F.lower(drug).alias("drug"), _first(after, STRENGTH).alias("strength"), F.lower(_first(after, FORM)).alias("form"), F.lower(_first(after, ROUTE)).alias("route"),
            F.lower(_first(after, FREQUENCY)).alias("frequency"), F.lower(_first(after, DOSAGE)).alias("dosage"), F.lower(_first(after, DURATION)).alias("duration"), strip(context).alias("context"),
        )

    return F.transform(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_ANY_NAME), F.lit(1)), F.lower)), linked)


def dosage(strength: Column) -> Column:
    """Number and unit, lower-cased, with one space between; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(strength, STRENGTH, 1)), r"([\d.])\s*([a-z])", "$1 $2"), F.lit(""))


def times_per_day(frequency: Column) -> Column:
    """How often a day; null for frequencies that don't say (as needed)."""
    f = F.lower(F.trim(frequency))
    hours = F.try_to_number(F.nullif(F.regexp_extract(f, r"(?:every\s+|q)(\d+)\s*h", 1), F.lit("")), F.lit("999"))
    return (
        F.when(F.nullif(hours, F.lit(0)).isNotNull(), F.round(24 / F.nullif(hours, F.lit(0)).cast("double"), 6))
        .when(f.rlike(r"\b(twice|bid)\b|\b2 times"), 2.0)
        .when(f.rlike(r"\b(three times|tid)\b|\b3 times"), 3.0)
        .when(f.rlike(r"\b(four times|qid)\b|\b4 times"), 4.0)
        .when(f.rlike(r"\b(once|daily|qd|qhs|at bedtime|nightly)\b"), 1.0)
    )


def mentions(text: Column, drug: Column) -> Column:
    """How often the drug's name is a word of the text."""
    return F.regexp_count(text, F.concat(F.lit(r"(?iu)\b\Q"), drug, F.lit(r"\E\b"))).cast("int")


def effectiveness(context: Column) -> Column:
    """refractory, successful or unknown, by words of the context; failure is looked for first."""
    c = F.lower(F.coalesce(context, F.lit("")))
    return (
        F.when(c.rlike(r"refractory|ineffective|uncontrolled|not effective|not control|failed|breakthrough|continued seizures|not working"), "refractory")
        .when(c.rlike(r"effective|successful|well controlled|controlled|seizure[- ]free|improved|responded|helped"), "successful")
        .otherwise("unknown")
    )


_SEIZURE = r"(?iu)\b(tonic[- ]clonic|seizures?|convulsions?|status epilepticus|absence|focal|myoclonic|aura|ictal)\b"
_NO_SEIZURE = r"(?iu)\b(?:no|denies|denied|without|free of|negative for)\s+(?:(?!but\b|however\b)[\w-]+\s+){0,3}?(?:seizures?|convulsions?)\b|\bseizure[- ]free\b"


def seizures(text: Column) -> Column:
    """(status, symptoms): positive if a word for a seizure stands outside a negation, negative if only inside one, else unknown."""
    said = F.regexp_replace(F.coalesce(text, F.lit("")), _NO_SEIZURE, " ")
    found = F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit(_SEIZURE), F.lit(1)), F.lower))
    status = F.when(F.size(found) > 0, "positive").when(text.rlike(_NO_SEIZURE), "negative").otherwise("unknown")
    return F.struct(status.alias("status"), F.array_join(found, "|").alias("symptoms"))


def build_registry(notes: DataFrame, extract: Callable[[Column], Column] = medications) -> DataFrame:
    """The registry: a row per note and drug of it; notes without a drug have none.

    notes: as split_notes gives them, with source_text_file if it is known. row_id counts the rows of a patient in the
    order of notes and mentions; a patient with any share of all rows is numbered by many tasks.
    """
    file = F.col("source_text_file") if "source_text_file" in notes.columns else F.format_string("%s/%s_%s_seizure_note.txt", "patient_id", "note_date", "patient_id")
    n = notes.filter("note_date is not null and note_text is not null").withColumn("seizure", seizures(F.col("note_text"))).withColumn("file", file)
    rows = n.select("*", F.posexplode(extract(F.col("note_text"))).alias("med_idx", "med")).filter("med.drug is not null")
    rows = number_rows(rows, ["note_idx", "med_idx"], "row_no", start=1, within=["patient_id"])
    drug = F.lower(strip(F.col("med.drug")))
    return rows.select(
        F.concat_ws("-", "patient_id", F.col("row_no").cast("string")).alias("row_id"), "patient_id", "note_date", "note_id", F.col("file").alias("source_text_file"), F.col("note_date").alias("source_date_key"),
        drug.alias("medication"), dosage(F.col("med.strength")).alias("medication_dosage"), times_per_day(F.col("med.frequency")).alias("intake_times_per_day"),
        mentions(F.col("note_text"), drug).alias("drug_mention_count"), effectiveness(F.col("med.context")).alias("medication_effectiveness"), F.col("seizure.status").alias("seizure_status"),
        F.col("seizure.symptoms").alias("seizure_symptoms"), F.col("med.route").alias("route"), F.col("med.form").alias("form"), "note_text", F.col("med.context").alias("extraction_context"),
    ).select(*REGISTRY.names)

"""What a natural-language query asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import contains_any, first_named
from ..functions.text import FLAGS

#: Words and patterns that are looked for, in order of precedence.
SYMPTOMS = ["seizure", "convulsion", "tonic-clonic", "absence", "focal", "ictal"]
WORKED = ["effective", "successful", "worked", "helped", "controlled", "seizure-free", "improved"]
FAILED = ["ineffective", "failed", "not working", "refractory", "breakthrough", "continued seizures"]
NEGATED = ["no seizure", "without seizure", "seizure-free", "no convulsion"]
PATIENT = [r"patient\s*(?:id|#|number)?\s*:?\s*(\d{6,})", r"patient\s+(\d{6,})", r"pt\s*#?\s*(\d{6,})", r"id\s*:?\s*(\d{6,})"]
#: What a day and a span of days look like.
DAY = r"\d{4}-\d{2}-\d{2}"
SPAN = rf"from\s+({DAY})\s+to\s+({DAY})"
#: Words that tell that seizures are the question.
SEIZURE_WORDS = ["seizure", "convulsion", "ictal"]


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, FLAGS + pattern, group), F.lit(""))


def intent(query: Column, whole_words: bool = False) -> Column:
    """A struct of intent_type, patient_id, medication, date_start, date_end, symptoms, effectiveness, seizure_status.

    A drug's name counts wherever it is a substring (so "level" names one), or with whole_words only as a word. Null and
    empty queries are general and ask for nothing.
    """
    q = F.lower(F.coalesce(query, F.lit("")))
    patient = F.coalesce(*[_found(q, p, 1) for p in PATIENT])
    drug = first_named(q, whole_words)
    start = F.coalesce(_found(q, SPAN, 1), _found(q, f"({DAY})", 1))
    symptoms = F.filter(F.array(*map(F.lit, SYMPTOMS)), lambda s: q.contains(s))
    outcome = F.when(contains_any(q, WORKED), "successful").when(contains_any(q, FAILED), "refractory")
    status = F.when(contains_any(q, SEIZURE_WORDS), F.when(contains_any(q, NEGATED), "negative").otherwise("positive"))
    kind = F.when(patient.isNotNull(), "patient_specific").when(drug.isNotNull(), "cohort").otherwise("general")
    return F.struct(
        kind.alias("intent_type"), patient.alias("patient_id"), drug.alias("medication"), start.alias("date_start"), _found(q, SPAN, 2).alias("date_end"),
        symptoms.alias("symptoms"), outcome.alias("effectiveness"), status.alias("seizure_status"),
    )


def with_intent(queries: DataFrame, text: str = "query", whole_words: bool = False) -> DataFrame:
    """Queries with their intent; explicit filters in columns filter_* win over it unless null or empty."""
    out = queries.withColumn("intent", intent(F.col(text), whole_words))
    for c in ("patient_id", "medication", "date_start", "date_end"):
        own = F.nullif(F.col(f"filter_{c}"), F.lit("")) if f"filter_{c}" in queries.columns else F.lit(None).cast("string")
        out = out.withColumn(f"want_{c}", F.coalesce(own, F.col("intent")[c]))
    return out

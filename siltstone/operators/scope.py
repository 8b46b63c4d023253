"""Which chunks a query may see: filters, and their relaxation when they leave too few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import canonical, normal, search_terms
from ..shared import saved, small

ENOUGH, DAYS = 10, 90


def names_match(medication: Column, terms: Column) -> Column:
    """Whether a (nullable) medication contains any of the names; a null one matches nothing."""
    return F.coalesce(F.exists(terms, lambda t: F.contains(F.lower(medication), t)), F.lit(False))


def _widened(day: Column, days: int) -> Column:
    """An ISO day moved by some days; null if it isn't a day, and then no bound."""
    return F.date_format(F.date_add(F.try_to_date(day, "yyyy-MM-dd"), days), "yyyy-MM-dd")


PARTS = ("pid", "med", "ds", "de")


def _asked(queries: DataFrame) -> DataFrame:
    q = queries.select(
        "query_id", F.nullif(F.col("want_patient_id"), F.lit("")).alias("pid"), F.nullif(normal(F.col("want_medication")), F.lit("")).alias("med"),
        F.nullif(F.col("want_date_start"), F.lit("")).alias("ds"), F.nullif(F.col("want_date_end"), F.lit("")).alias("de"),
    ).withColumn("terms", F.when(F.col("med").isNotNull(), search_terms(F.col("med"))))
    return q.withColumn("wide_s", _widened(F.col("ds"), -DAYS)).withColumn("wide_e", _widened(F.col("de"), DAYS))


def _inside(lo: str, hi: str) -> Column:
    return (F.col(lo).isNull() | (F.col("note_date") >= F.col(lo))) & (F.col(hi).isNull() | (F.col("note_date") <= F.col(hi)))


def scope(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, vector_id, date_relaxed, medication_dropped: the chunks each query may see.

    queries: query_id and want_patient_id, want_medication, want_date_start, want_date_end, each null if not asked for.
    If fewer than 10 chunks pass, dates are widened by 90 days, if that gives 10; else the medication is dropped, if that
    gives 10; else the few stay. A query whose filters nothing passes has no rows: it never sees what it didn't ask for.

    Whether filters are relaxed is decided on a count of the chunks by patient, drug and day, which is far smaller than
    the chunks; queries that name a patient meet it by hash join on the patient. Chunks are then filtered once, by the
    filters chosen; queries without filters take them all.
    """
    q = _asked(queries)
    c = chunks.select("vector_id", F.col("patient_id").cast("string").alias("patient_id"), F.col("note_date").cast("string").alias("note_date"), "medication")
    yes = lambda c: F.coalesce(c, F.lit(False))
    drug = F.col("med").isNull() | names_match(F.col("medication"), F.col("terms"))
    kinds = {"base": yes(_inside("ds", "de") & drug), "relaxed": yes(_inside("wide_s", "wide_e") & drug), "nomed": yes(_inside("ds", "de"))}
    filtered = q.filter(F.coalesce(*PARTS).isNotNull())
    cells = saved(c.groupBy("patient_id", "note_date", "medication").agg(F.count("*").alias("n")))
    days = cells.groupBy("note_date", "medication").agg(F.sum("n").alias("n"))
    named, others = filtered.filter("pid is not null"), filtered.filter("pid is null")
    met = cells.join(small(named), F.col("patient_id") == F.col("pid")).select("query_id", *PARTS, "terms", "wide_s", "wide_e", "note_date", "medication", "n")
    # filters that name no patient, a stated set, meet the days and drugs there are
    met = met.unionByName(days.join(small(others), F.lit(True)).select(*met.columns))
    count = met.groupBy("query_id").agg(*[F.sum(F.when(k, F.col("n")).otherwise(0)).alias(f"n_{name}") for name, k in kinds.items()])
    choice = (
        F.when(F.col("n_base") >= ENOUGH, "base")
        .when(F.coalesce("ds", "de").isNotNull() & (F.col("n_relaxed") >= ENOUGH), "relaxed")
        .when(F.col("med").isNotNull() & (F.col("n_nomed") >= ENOUGH), "nomed")
        .otherwise("base")
    )
    chosen = filtered.join(count, "query_id").select("query_id", "pid", "terms", choice.alias("choice"), "med", "ds", "de", "wide_s", "wide_e")
    relaxed, dropped = F.col("choice") == "relaxed", F.col("choice") == "nomed"
    chosen = saved(chosen.select("query_id", "pid", F.when(~dropped, F.col("med")).alias("med"), "terms", F.when(relaxed, F.col("wide_s")).otherwise(F.col("ds")).alias("ds"), F.when(relaxed, F.col("wide_e")).otherwise(F.col("de")).alias("de"), relaxed.alias("date_relaxed"), dropped.alias("medication_dropped")))
    passes, out = yes(_inside("ds", "de") & drug), ["query_id", "vector_id", "date_relaxed", "medication_dropped"]
    one = c.join(small(chosen.filter("pid is not null")), F.col("patient_id") == F.col("pid")).filter(passes).select(*out)
    many = c.join(small(chosen.filter("pid is null")), passes).select(*out)
    free = q.filter(F.coalesce(*PARTS).isNull()).select("query_id", F.lit(False).alias("date_relaxed"), F.lit(False).alias("medication_dropped"))
    return one.unionByName(many).unionByName(c.select("vector_id").join(small(free), F.lit(True)).select(*out))


def filters_applied(queries: DataFrame, scoped: DataFrame) -> DataFrame:
    """query_id and a map of the filters in force, with date_relaxed and medication_dropped where they were."""
    flags = scoped.groupBy("query_id").agg(F.max("date_relaxed").alias("r"), F.max("medication_dropped").alias("d"))
    entry = lambda name, value, there: F.when(there, F.struct(F.lit(name).alias("key"), value.alias("value")))
    pair = lambda name, value: entry(name, value, value.isNotNull() & (value != ""))
    out = queries.join(flags, "query_id", "left")
    entries = F.array_compact(
        F.array(
            pair("patient_id", F.col("want_patient_id")), pair("date_start", F.col("want_date_start")), pair("date_end", F.col("want_date_end")),
            pair("medication", F.when(F.col("want_medication").isNotNull(), canonical(F.col("want_medication")))),
            entry("date_relaxed", F.lit("true"), F.col("r")), entry("medication_dropped", F.lit("true"), F.col("d")),
        )
    )
    return out.select("query_id", F.map_from_entries(entries).alias("filters_applied"))

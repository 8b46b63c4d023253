"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification; DataFrame functions only.

Items are partitioned by the size of their shingle sets: class j holds sizes 2**j .. 2**(j+1) - 1. For containment t the
class's sketch is the m = floor((1 - t) * (2**(j+1) - 1)) + 1 least hashes of an item's set, or the whole set if that is
smaller. At most m - 1 shingles may be missing from a document that holds the share t of the item, so one of the m
least is among the document's, however long it is: the search loses nothing, and hashes above the classes' largest
retained one are never looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, with_row_key

SPACE = "[\\x20\\x09-\\x0D]+"
#: Retained hashes that may be a literal of the plan and a broadcast table; above it they are joined by shuffle.
FEW = 50_000


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once a row: the optimiser may copy a column's expression, not a lambda's variable."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _words(text: Column) -> Column:
    """Words with A-Z lower-cased; empty for null and blank texts."""
    parts = F.split(F.regexp_replace(ascii_lower(text), f"^{SPACE}", ""), SPACE)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda w: w != "")


def _shingles(words: Column, n: int, f) -> Column:
    """f of every run of n words, in order; empty if there are fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: f(F.slice(words, i, n)))).otherwise(F.array())


def find_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of every pair in which a document holds an item.

    A document holds an item if at least the share `threshold` of the item's distinct n-word shingles occurs in it. An
    item of fewer than n words is one shingle of its own length. Items and documents that are null or have no words match
    nothing. Rows that repeat an id give one row with the largest containment. The whole text of every document is
    searched. Items are assumed far fewer than documents, but no bound is needed: many are joined by shuffle.
    """
    own = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"), F.least(F.size(_words(F.col(f"`{text}`"))), F.lit(n)).alias("k")).filter("k > 0")
    lengths = sorted(r["k"] for r in own.select("k").distinct().collect()) or [n]  # n at most
    phrase = lambda s: F.concat_ws(" ", s)
    of = lambda k: _let(_words(F.col("text")), lambda w: _shingles(w, k, phrase))
    branch = F.array().cast("array<string>")
    for k in lengths:
        branch = F.when(F.col("k") == k, of(k)).otherwise(branch)
    own = own.select("item_id", F.array_distinct(branch).alias("s")).withColumn("q", F.size("s"))
    least = F.sort_array(F.transform("s", lambda s: F.xxhash64(s)))
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("q"))) + 1) - 1  # the largest size of the class
    m = F.least(F.col("q"), (F.floor((1 - threshold) * top + 1e-9) + 1).cast("int"))
    retained = own.select("item_id", F.explode(F.slice(least, F.lit(1), m)).alias("h")).distinct()
    count, ceiling = retained.agg(F.count("*"), F.max("h")).first()
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = lambda f: _let(_words(F.col("text")), lambda w: F.concat(*[_shingles(w, k, f) for k in lengths]))
    low = F.filter(runs(lambda s: F.xxhash64(phrase(s))), lambda h: h <= F.lit(ceiling if ceiling is not None else -(2**63)))
    if count <= FEW:
        held = F.array(*[F.lit(r["h"]) for r in retained.select("h").distinct().collect()]).cast("array<bigint>")
        d = d.withColumn("low", low).filter(F.arrays_overlap("low", held))
        met = d.select("doc_id", "text", F.explode(F.array_intersect("low", held)).alias("h")).join(F.broadcast(retained), "h")
        met = met.join(F.broadcast(own), "item_id")
    else:
        found = d.select("doc_id", F.explode(F.array_distinct(low)).alias("h")).join(retained, "h").select("doc_id", "item_id").distinct()
        met = d.join(found, d["doc_id"].eqNullSafe(found["doc_id"])).drop(found["doc_id"]).join(own, "item_id")
    met = met.select("doc_id", "item_id", "q", F.size(F.array_intersect("s", runs(phrase))).alias("found"))
    met = met.filter(F.col("found") >= F.col("q") * threshold - 1e-9)
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("found") / F.col("q")).alias("share"), "found", "q")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.q").cast("long").alias("n_shingles"), F.col("b.found").cast("long").alias("n_found"), (F.col("b.found") / F.col("b.q")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """The rows, all columns, that hold no item. Each row is judged by itself and told from others by its place, so rows
    with null or repeated ids do no harm to one another."""
    keyed = with_row_key(docs)
    place = F.struct("__file", "__row")
    bad = find_items(keyed.select(place.alias("doc_id"), F.col(f"`{text}`").alias("text")), items.select("item_id", "text"), n, threshold).select(F.col("doc_id.__file").alias("f"), F.col("doc_id.__row").alias("r")).distinct()
    return keyed.join(bad, (F.col("__file") == F.col("f")) & (F.col("__row") == F.col("r")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of every document that holds a benchmark item.

    Null, empty and wordless texts on either side match nothing; null ids are an id like others; rows that repeat an id
    give one row with the largest containment; texts of any length are searched whole; empty tables give no rows.
    """
    return find_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
         ELSE [array_to_string(w, ' ')] END) AS s, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT k FROM si),
sd AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM d, n WHERE len(w) >= k),
q AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM sd JOIN si USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN q USING (item_id) WHERE n_found >= n_shingles * 0.8 - 1e-9
"""

"""Notes and the registry made from them."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import notes as n
from siltstone.schema import REGISTRY

FILE = """preamble that belongs to nothing
FILE: a.txt | DATE: 20200105
======
======
Started Keppra 500 MG tablet PO BID. No seizures.

file:  b.txt  |  date: 20201340
bad date
FILE: c.txt | DATE: 20200301
FILE: d.txt | DATE: 20200302
==
Lamictal 25mg daily failed. Focal seizures continue; no convulsions. On keppra and Keppra.
"""


def split(spark, content, **options):
    df = spark.createDataFrame([("100001", content)], "patient_id string, content string")
    return n.split_notes(df, **options).orderBy("note_idx").collect()


def test_split(spark):
    got = split(spark, FILE.replace("\n", "\r\n"))
    assert [(r.note_idx, r.note_date, r.note_id) for r in got] == [(1, "2020-01-05", "100001_2020-01-05_001"), (2, "2020-03-02", "100001_2020-03-02_002")]
    assert got[0].note_text.startswith("started keppra 500 mg tablet PO (by mouth) BID (twice daily).")
    raw = split(spark, FILE, cleaned=False)
    assert raw[0].note_text == "Started Keppra 500 MG tablet PO BID. No seizures."
    assert split(spark, "no header") == [] and split(spark, None) == [] and split(spark, "") == []


def test_faithful_headers_leave_their_rest(spark):
    got = split(spark, "FILE: a.txt | DATE: 20200105\n====\nBody of the note.", faithful_headers=True)
    assert [(r.note_date, r.note_text) for r in got] == [("2020-01-05", "a.txt | DATE:\n20200105\n====\nbody of the note.")]


def test_registry(spark):
    df = spark.createDataFrame([("7", FILE), ("8", "FILE: x | DATE: 20210101\nnothing named")], "patient_id string, content string")
    got = n.build_registry(n.split_notes(df)).orderBy("row_id").collect()
    assert got[0].__fields__ == REGISTRY.names
    assert [(r.row_id, r.medication, r.medication_dosage, r.intake_times_per_day, r.drug_mention_count, r.medication_effectiveness, r.seizure_status, r.route, r.form) for r in got] == [
        ("7-1", "keppra", "500 mg", 2.0, 1, "unknown", "negative", "po", "tablet"),
        ("7-2", "lamictal", "25 mg", 1.0, 1, "refractory", "positive", None, None),
        ("7-3", "keppra", None, None, 2, "refractory", "positive", None, None),
    ]
    assert got[1].seizure_symptoms == "focal|seizures"
    assert n.build_registry(n.split_notes(df.limit(0))).count() == 0


@pytest.mark.parametrize("f,want", [("every 8 hours", 3.0), ("q6h", 4.0), ("BID", 2.0), ("once daily", 1.0), ("as needed", None), (None, None), ("every 0 hours", None), ("at bedtime", 1.0), ("four times a day", 4.0)])
def test_frequencies(spark, f, want):
    assert spark.createDataFrame([(f,)], "f string").select(n.times_per_day(F.col("f"))).first()[0] == want

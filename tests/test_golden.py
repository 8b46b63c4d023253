"""Cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.aliases import expand, search_terms
from siltstone.operators import metrics as m
from siltstone.operators.chunk import chunks, split_list
from siltstone.operators.fusion import average_rank, min_max, rank_norm
from siltstone.operators.intent import intent
from siltstone.operators.scope import _widened


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "query,want",
    [
        ("Did patient 115154574 experience seizures on levetiracetam?", dict(intent_type="patient_specific", patient_id="115154574", medication="levetiracetam", symptoms=["seizure"], seizure_status="positive")),
        ("What patients were on lamotrigine from 2021-01-01 to 2021-06-30?", dict(intent_type="cohort", medication="lamotrigine", date_start="2021-01-01", date_end="2021-06-30", symptoms=[])),
        ("How effective is levetiracetam for seizure control?", dict(intent_type="cohort", effectiveness="successful", seizure_status="positive")),
        ("What medications help with tonic-clonic seizures?", dict(intent_type="general", medication=None, symptoms=["seizure", "tonic-clonic"], seizure_status="positive")),
        ("the level was ineffective", dict(intent_type="cohort", medication="levetiracetam", effectiveness="successful")),
        ("did 123456 seizure-free", dict(patient_id="123456", seizure_status="negative")),
        ("since 2020-02-03", dict(intent_type="general", date_start="2020-02-03", date_end=None)),
        (None, dict(intent_type="general", patient_id=None, symptoms=[])),
    ],
)
def test_intent(spark, query, want):
    got = one(spark, query, intent)
    assert {k: got[k] for k in want} == want


def test_whole_words_only(spark):
    assert one(spark, "the level was ineffective", lambda x: intent(x, True)).medication is None
    assert one(spark, "on lev and food", lambda x: intent(x, True)).medication == "levetiracetam"


def test_expansion_and_terms(spark):
    assert one(spark, "Patient on Keppra for seizure control", expand) == "Patient on Keppra for seizure control levetiracetam keppra lev"
    assert one(spark, "  VPA ", search_terms)[:2] == ["valproate", "valproic acid"]
    assert one(spark, "unknown  Thing", search_terms) == ["unknown thing"] and one(spark, " ", search_terms) == []


@pytest.mark.parametrize(
    "parts,lengths", [([199], []), ([200], [200]), ([1500], [1200, 702, 402]), ([700, 700], [700, 902]), ([100, 1190], [1292]), ([49], []), ([], []), ([600, 598], [1200]), ([300, 1201, 300], [300, 1402, 403, 402, 502])]
)
def test_chunk_lengths(spark, parts, lengths):
    assert [len(c) for c in one(spark, "\n\n".join("x" * n for n in parts), chunks)] == lengths


def test_null_text_has_no_chunks(spark):
    assert one(spark, None, chunks) == []


def test_dates_widened(spark):
    assert one(spark, "2021-01-01", lambda c: _widened(c, -90)) == "2020-10-03" and one(spark, "2021-12-31", lambda c: _widened(c, 90)) == "2022-03-31"
    assert one(spark, "2021-13-01", lambda c: _widened(c, 90)) is None


def test_ranks_and_scaling(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("a", 0.5), ("b", 0.3), ("c", 0.0), ("c", 0.0)], "query_id string, s double")
    got = df.select("query_id", "s", average_rank(F.col("s")).alias("r"), rank_norm(F.col("s")).alias("n"), min_max(F.col("s"), Window.partitionBy("query_id")).alias("m")).orderBy("query_id", F.desc("s")).collect()
    assert [(x.r, x.n) for x in got] == [(1, 1), (2.5, 0.25), (2.5, 0.25), (1, 1), (1.5, 0.5), (1.5, 0.5)]
    assert [x.m for x in got] == [1, 0, 0, 0.3, 0, 0]


def test_metrics(spark):
    q = spark.createDataFrame([("q", ["b", "c", "d"]), ("none", ["x"]), ("unlabelled", [])], "query_id string, relevant array<string>")
    r = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("unlabelled", "a", 1)], "query_id string, chunk_id string, rank int")
    got = {x.query_id: x for x in m.ranking_metrics(q, r).collect()}
    assert [round(got["q"][c], 4) for c in ("precision", "recall", "rr", "ap")] == [0.2, 0.6667, 0.5, 0.3889]
    assert [got["none"][c] for c in ("n_retrieved", "precision", "recall", "rr", "ap")] == [0, 0, 0, 0, 0]
    assert got["unlabelled"].recall == got["unlabelled"].ap == 0
    assert m.ranking_metrics(q, r, 0).filter("precision <> 0").count() == 0


@pytest.mark.parametrize("s,want", [("{'patient_id': '115'}", {"patient_id": "115"}), ("broken {", {}), (None, {}), ("", {}), ('"{\'a\': \'b\'}"', {"a": "b"}), ("{}", {})])
def test_filter_json(spark, s, want):
    assert one(spark, s, m.filter_map) == want


@pytest.mark.parametrize("s,want", [("c1|c2|c2", ["c1", "c2"]), ("", []), (None, []), ("a", ["a"])])
def test_relevant_ids(spark, s, want):
    assert one(spark, s, m.relevant_ids) == want


def test_symptoms(spark):
    assert one(spark, "a | |b", split_list) == ["a", "b"] and one(spark, None, split_list) == []

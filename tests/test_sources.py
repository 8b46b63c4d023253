"""Files in and out."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.plans.build import build_index, registry_from_files, write_index
from siltstone.plans.evaluate import evaluate, score_report
from siltstone.schema import REQUIRED, require
from siltstone.sources import files
from siltstone.sources.xlsx import XlsxSource, write_workbook
from siltstone.streaming.append import append_notes

NOTE = "FILE: n{k}.txt | DATE: 2020010{k}\n====\n" + "The patient takes Keppra 500 mg BID and had no seizures. " * 8 + "\n"


@pytest.fixture
def root(tmp_path):
    for p in ("100001", "100002"):
        d = tmp_path / f"Patient_{p}"
        d.mkdir()
        (d / f"{p}_seizure_context.txt").write_bytes("".join(NOTE.format(k=k) for k in (1, 2)).encode() + ("café".encode("cp1252") if p == "100002" else "café".encode()))
    (tmp_path / "Patient_100003").mkdir()
    (tmp_path / "Other_1").mkdir()
    (tmp_path / "Other_1" / "1_seizure_context.txt").write_text("x")
    return str(tmp_path)


def test_files_to_index_and_evaluation(spark, root):
    got = files.patient_files(spark, root).collect()
    assert sorted(r.patient_id for r in got) == ["100001", "100002"] and all(r.content.endswith("café") for r in got)
    registry = registry_from_files(spark, root, f"{root}/out")
    assert registry.count() == 4
    back = files.read_registry(spark, f"{root}/out/all_patients_combined.parquet")
    text = files.read_registry_csv(spark, f"{root}/out/all_patients_combined.csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, registry.collect()))
    assert sorted((r.row_id, r.note_text) for r in text.collect()) == sorted((r.row_id, r.note_text) for r in registry.collect())
    assert sum(f.endswith(".txt") for _, _, names in os.walk(f"{root}/out/notes") for f in names) == 4
    chunks = write_index(build_index(back), f"{root}/index")
    assert sorted(r.vector_id for r in chunks.collect()) == list(range(chunks.count()))
    assert files.read_index_info(spark, f"{root}/index/index_info.json").first()["n_patients"] == 2
    ids = [r.chunk_id for r in chunks.orderBy("vector_id").collect()]
    rows = [("1", "Which patient takes Keppra?", "cohort", "{'patient_id': '100001'}", ids[0]), ("2", "patient 999999", "patient_specific", "", "x")]
    labelled = spark.createDataFrame(rows, "Query_Number string, Query_Text string, Intent_Type string, Filters_Applied string, Relevant_Chunk_IDs string")
    write_workbook({"queries": labelled}, f"{root}/queries.xlsx")
    labelled.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{root}/queries.csv")
    for kind in ("csv", "xlsx"):
        q = files.labelled_queries(spark, f"{root}/queries.{kind}")
        assert sorted((r.query_id, r.filters, r.relevant) for r in q.collect()) == [("1", {"patient_id": "100001"}, [ids[0]]), ("2", {}, ["x"])]
    e = evaluate(q, chunks, out=f"{root}/eval")
    got = {r.query_id: r for r in e.per_query.collect()}
    assert got["1"].rr > 0 and got["2"].n_retrieved == 0
    assert {r.chunk_id for r in e.results.collect()} <= {r.chunk_id for r in chunks.filter("patient_id = '100001'").collect()}
    assert e.summary.filter("level = 'overall'").first()["num_queries"] == 2
    report = score_report(q.withColumn("query_type", F.col("intent_type")), chunks, out=f"{root}/report")
    assert report["Export"].count() == 2
    assert sorted(os.listdir(f"{root}/report/charts")) == [f"{n}.svg" for n in ("dashboard", "performance_by_type", "score_components", "score_distributions", "scores_by_query")]


def test_refusals(spark, root):
    with pytest.raises(ValueError, match="unsupported"):
        files.labelled_queries(spark, f"{root}/queries.txt")
    with pytest.raises(ValueError, match="note_text"):
        require(spark.range(1), REQUIRED)
    with pytest.raises(ValueError, match="kind"):
        files.write_table(spark.range(1), root, "orc")
    empty = build_index(spark.createDataFrame([], "row_id string, patient_id string, note_id string, note_date string, note_text string, medication string"))
    with pytest.raises(RuntimeError, match="no chunks"):
        write_index(empty, f"{root}/none")


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & <b>", 1.5, True), (2, None, None, False), (3, " x\né ", float("nan"), None)], "n int, s string, d double, b boolean")
    write_workbook({"one": df, "two": df.limit(0)}, f"{tmp_path}/x.xlsx", widths={"s": 3})
    spark.dataSource.register(XlsxSource)
    got = spark.read.format("xlsx").load(f"{tmp_path}/x.xlsx").orderBy("n").collect()
    assert [tuple(r) for r in got] == [("1", "a & <b>", "1.5", "1"), ("2", None, None, "0"), ("3", " x\né ", "nan", None)]


def test_stream_appends_batches(spark, tmp_path):
    spark.createDataFrame([("1", NOTE.format(k=1)), ("2", NOTE.format(k=2))], "patient_id string, content string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        append_notes(spark, f"{tmp_path}/in", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/registry").count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/chunks").filter("size(embedding) = 64").count() == 2


def test_workbook_leaves_no_rows_out(spark, tmp_path):
    df = spark.range(3)
    write_workbook({"all": df}, f"{tmp_path}/x.xlsx", most=3)
    with pytest.raises(ValueError):
        write_workbook({"more": df}, f"{tmp_path}/y.xlsx", most=2)


def test_report_has_a_sheet_for_every_query(spark, tmp_path, monkeypatch):
    from siltstone.plans import evaluate as e

    class Any:  # stands for every table but the queries
        def __getattr__(self, name):
            return lambda *args, **kwargs: self

    sheets = {}
    monkeypatch.setattr(e, "retrieve", lambda *args, **kwargs: type("R", (), {"results": Any()}))
    monkeypatch.setattr(e, "saved", lambda df: df)
    monkeypatch.setattr(e, "m", Any())
    monkeypatch.setattr(e, "write_charts", lambda *args: None)
    monkeypatch.setattr(e, "write_workbook", lambda s, *args, **kwargs: sheets.update(s))
    score_report(spark.range(205).selectExpr("id as query_id", "'q' as query", "'t' as query_type"), None, out=f"{tmp_path}")
    assert sum(name.startswith("Query ") for name in sheets) == 205

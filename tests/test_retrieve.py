"""The whole retrieval over a small corpus."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import vector
from siltstone.operators.answer import SYSTEM, answers, chat_service, local_model, register_backend
from siltstone.operators.lexical import bm25
from siltstone.plans.build import build_index
from siltstone.plans.numbering import number_rows
from siltstone.plans.retrieve import Settings, retrieve, retrieve_one, retrieve_simple

DRUGS = ["keppra", "lamictal", None]


@pytest.fixture(scope="module")
def registry(spark):
    rows = [(f"{100000 + p}-{k}", str(100000 + p), f"n{p}_{k}", f"2020-{k:02d}-15", f"Note {k} of patient {p}: seen for seizures on {DRUGS[(p + k) % 3]}. " * 6, DRUGS[(p + k) % 3], "positive") for p in range(4) for k in range(1, 13)]
    return spark.createDataFrame(rows, "row_id string, patient_id string, note_id string, note_date string, note_text string, medication string, seizure_status string")


@pytest.fixture(scope="module")
def chunks(spark, registry, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/chunks"
    build_index(registry).write.parquet(path)
    return spark.read.parquet(path)


def test_patients_stay_apart(spark, registry, chunks):
    q = spark.createDataFrame([("a", "seizures of patient 100001"), ("b", "seizures of patient 100002"), ("c", "patient 999999"), ("d", "anything")], "query_id string, query string")
    r = retrieve(q, chunks, registry)
    rows = r.results.collect()
    assert {x.patient_id for x in rows if x.query_id == "a"} == {"100001"} and {x.patient_id for x in rows if x.query_id == "b"} == {"100002"}
    assert not [x for x in rows if x.query_id == "c"] and [x for x in rows if x.query_id == "d"]
    trail = {x.query_id: x for x in r.audit.collect()}
    assert trail["c"].empty_scope and not trail["a"].empty_scope
    assert trail["a"].filters_applied == {"patient_id": "100001"} and trail["a"].pipeline_stats.final_results == 10
    assert [s["rank"] for s in trail["a"].score_breakdown] == list(range(1, 11))
    for side in ("semantic", "lexical"):
        for k in "abd":
            raw = {(x[f"score_{side}"] or 0, x[f"score_{side}_norm"]) for x in rows if x.query_id == k}
            assert all(0 <= n <= 1 for _, n in raw) or all(s == n for s, n in raw)  # equal scores stay as they are
    assert all(0 <= x.score_ce <= 1 for x in rows)
    joined = r.registry.collect()
    assert len(joined) == len(rows) and all(x.row_id == x.source_row_id and x.patient_id_registry == x.patient_id for x in joined)


def test_single_query_and_fallback(spark, registry, chunks):
    out = retrieve_one(spark, "on keppra", chunks, registry, patient_id="100003", date_start="2020-03-01", date_end="2020-06-30")
    assert set(out) == {"results", "registry", "audit"}
    a = out["audit"].first()
    assert a.filters_applied["medication"] == "levetiracetam" and a.filters_applied["patient_id"] == "100003"
    assert retrieve_simple(spark, "patient 999999", chunks).count() == 0
    leaked = retrieve_simple(spark, "patient 999999", chunks, settings=Settings(unscoped_fallback=True))
    assert leaked.count() == 10 and leaked.filter("score_final <> score_semantic").count() == 0


def test_failed_reranker(spark, chunks):
    r = retrieve(spark.createDataFrame([("a", "seizures")], "query_id string, query string"), chunks, rerank=None)
    assert {x.score_ce_norm for x in r.results.collect()} == {0.5}


def test_answers(spark, chunks):
    q = spark.createDataFrame([("a", "seizures of patient 100001"), ("b", "patient 999999")], "query_id string, query string")
    found = retrieve(q, chunks).results
    got = {x.query_id: x for x in answers(found, q).collect()}
    assert got["a"].answer.endswith("[Citation: see Sources [1]]") and len(got["a"].sources) == 8 and got["b"].sources == []
    assert [c.rank for c in got["a"].chunks] == list(range(1, 11)) and got["a"].chunks[0].chunk_text_full and got["b"].chunks == []
    register_backend("loud", lambda system, prompt: F.upper(F.concat(prompt, system)))
    assert answers(found, q, "loud", system="be brief").first()["answer"].startswith("QUESTION: ")
    assert answers(found, q, "loud", system="be brief").first()["answer"].endswith("BE BRIEF")
    with pytest.raises(ValueError):
        answers(found, q, "no such")


def test_models_behind_answers(spark):
    """A chat service and a model in the workers get the system prompt and the user's, and one bad reply spoils no other."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body))
            bad = "second" in body["messages"][1]["content"]
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"" if bad else json.dumps({"choices": [{"message": {"content": " said "}}]}).encode())

        def log_message(self, *args):
            pass

    asked: list = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    q = spark.createDataFrame([("a", "first"), ("b", "second")], "query_id string, query string")
    none = spark.createDataFrame([], "query_id string, rank int, chunk_id string, chunk_text_full string")
    try:
        register_backend("openai", chat_service(f"http://127.0.0.1:{server.server_port}/v1", "some-model", key="k"))
        got = {r.query_id: r.answer for r in answers(none, q, "openai").collect()}
    finally:
        server.shutdown()
    assert got["a"] == "said" and got["b"].startswith("Error calling the chat service")
    path, key, body = next(x for x in asked if "first" in x[2]["messages"][1]["content"])
    assert (path, key, body["model"], body["temperature"], body["max_tokens"]) == ("/v1/chat/completions", "Bearer k", "some-model", 0.1, 600)
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and body["messages"][0]["content"] == SYSTEM
    register_backend("hf", local_model(lambda: lambda text: text.splitlines()[-1] if "first" in text else " "))
    got = {r.query_id: r.answer for r in answers(none, q, "hf", system="S").collect()}
    assert got["a"] == "Sources:" and got["b"] == "Not found in chart."


def test_bm25_with_negative_mean(spark):
    """In a scope where most terms are in most texts scores may be negative, and texts without a term come first."""
    docs = spark.createDataFrame([(k, "a b" if k > 2 else "c") for k in range(1, 40)], "vector_id long, text string")
    q = spark.createDataFrame([("q", 0, "a b a")], "query_id string, scope_id int, query string")
    got = bm25(q, docs.select(F.lit(0).alias("scope_id"), "vector_id"), docs, 3).orderBy("rank_lexical").collect()
    assert [r.vector_id for r in got] == [1, 2, 3] and got[0].score_lexical == 0 and got[2].score_lexical <= 0


def test_numbers(spark):
    rows = [("hot" if k % 3 else f"p{k % 5}", k // 4, k) for k in range(500)]
    df = spark.createDataFrame(rows, "p string, d int, k int").repartition(7)
    got = {r.k: r.no for r in number_rows(df, ["d", "k"], "no", 1, ["p"]).collect()}
    want, seen = {}, {}
    for p, d, k in sorted(rows):
        seen[p] = seen.get(p, 0) + 1
        want[k] = seen[p]
    assert got == want
    assert sorted(r.no for r in number_rows(df, ["p", "k"], "no").collect()) == list(range(500))
    assert number_rows(df.limit(0), ["k"], "no").count() == 0


@pytest.mark.parametrize("numbers", [1 << 22, 40])
def test_vectors_of_several_sizes(spark, monkeypatch, numbers):
    """Vectors meet those of their own size only; null and non-finite ones take no part; more queries take more passes."""
    monkeypatch.setattr(vector, "NUMBERS", numbers)
    monkeypatch.setattr(vector, "ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=2 + k % 3), 1)]) for k in range(200)]
    odd = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [float("inf"), 1.0]), (905, [9.0, 9.0, None])]
    df = spark.createDataFrame(rows + odd, "vector_id long, embedding array<double>").repartition(3)
    asked = [(f"q{k}", v) for k, v in rows[:30]] + [(f"q{k}", v) for k, v in odd]
    got = vector.vector_top_k(spark.createDataFrame(asked, "query_id string, embedding array<double>"), df, 7).collect()
    want = set()
    for k, v in rows[:30]:
        best = sorted((-round(float(np.dot(v, w)), 9), j) for j, w in rows if len(w) == len(v))[:7]
        want |= {(f"q{k}", j, r, -s) for r, (s, j) in enumerate(best, 1)}
    assert {(x.query_id, x.vector_id, x.rank_semantic, x.score_semantic) for x in got} == want
    assert vector.vector_top_k(spark.createDataFrame([], "query_id string, embedding array<double>"), df).count() == 0
    assert vector.vector_top_k(spark.createDataFrame(asked[:1], "query_id string, embedding array<double>"), df.limit(0)).count() == 0

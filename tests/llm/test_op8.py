from siltstone.llm import op8_source_mix as op8
from tests.compare import assert_same, sql_rows, spark_rows


def test_sql(spark):
    assert_same(op8.op8_source_mix(spark, "/root/testdata/sf0.01"), op8.SQL, "/root/testdata/sf0.01")


def test_small_tables(spark, tables):
    schema = "doc_id long, text string, source string, size int, n string"
    rows = [(k, "w " * (k % 50), "abc"[k % 7 % 3], 1, "x") for k in range(3000)]
    rows += [(9000 + k, "null source words", None, 1, None) for k in range(20)] + [(None, "no id", "a", 1, "x"), (5, "again", "a", 1, "x"), (9999, None, "empty", 1, "x"), (9998, "", "empty", 1, "x"), (9997, "one two", "", 1, "x")]
    path = tables(documents=(rows, schema))
    got = op8.op8_source_mix(spark, path)
    assert spark_rows(got.filter("doc_id is not null")) == sql_rows(f"SELECT * FROM ({op8.SQL}) WHERE doc_id IS NOT NULL", path)
    by = {}
    for r, s in zip(sorted(got.collect(), key=repr), range(10**9)):
        assert r.taken in (0, r["size"], 2 * r["size"])
        t = by.setdefault((r.source_size, r.target), [0, 0])
        t[0] += r.taken
        t[1] = max(t[1], r["size"])
    for (size, target), (taken, largest) in by.items():
        assert abs(taken - target) <= largest and target <= 2 * size + 1e-9
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    assert spark_rows(got) == spark_rows(op8.op8_source_mix(spark, path))  # reruns agree


def test_the_mix_itself(spark, tables):
    rows = [(k, f"w{k} " * (1 + k % 9), "ab"[k % 2], "extra") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, passes string")
    mix = op8.mixed_documents(df)
    assert mix.columns == df.columns
    times = {}
    for r in mix.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = {r.doc_id: r.passes for r in op8.fair_mix(df).collect() if r.passes}
    assert times == want
    assert op8.mixed_documents(df.limit(0)).count() == 0

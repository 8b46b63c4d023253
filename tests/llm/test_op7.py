from tokenizers import Tokenizer

from siltstone.llm import op7_token_counts as op7
from siltstone.llm.common import tokenizer_path

from .test_op5 import ODD


def expected(texts):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts]


def test_odd_texts(spark):
    texts = [*ODD, "a  b   c ", " lead", "trail ", "\n\n\n  x", "it's 'tis ''s", "<|endoftext|>", "x<|endoftext|>y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as n_bytes", "'k' as k")
    got = sorted(op7.token_counts(df).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_tokens) for r in got] == expected(texts)
    assert all(r.over_limit == (r.n_tokens > 512) and r.k == "k" for r in got)
    assert op7.token_counts(df.limit(0)).count() == 0


def test_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7.op7_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == dict(zip(docs, expected(docs.values())))

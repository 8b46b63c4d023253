import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm.common import shared_dir, tokenizer_path
from siltstone.llm.op5_token_files import op5_token_files, pack, read_token_files, unpack, write_token_files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_code_round_trip(numbers):
    a = np.array(numbers, np.int64)
    control, data = pack(a)
    assert (unpack(control, data, len(a)) == a).all()
    assert len(control) == -(-len(a) // 4)


def expected(docs):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out, at = [], 0
    for k, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


ODD = [
    None, "", "  \n", "Hello, World! It's 2024 — naïve café", "ÀÉÎ ﬁ ½ ² ǅ İ ẞ", "<|endoftext|> x <|startoftext|>", "日本語 текст 😀👍🏽", "a" * 500, "x y z​q", "don't we'll I'M",
    "tab\tand\x0bvt\x0cff\x1cfs\x85nel", "é combining", "1234567 12.5e-3", "﻿bom", "ab" * 20_000,
]


def test_odd_texts(spark):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in reversed(docs)], "doc_id long, text string, start int, part int")
    got = read_token_files(spark, write_token_files(df, shared_dir(spark)), with_ids=True).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected(docs)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


@pytest.mark.parametrize("rows", [[], [(None, "a"), (1, "b"), (1, "b"), (1, "a")]])
def test_empty_tables_and_repeated_ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(read_token_files(spark, write_token_files(df, shared_dir(spark))).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [r.start for r in got] == [2 * k for k in range(len(rows))]


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op5_token_files(spark, sf).collect()) == expected(docs)


def test_files_ascend(spark, sf):
    """Read file by file in the order of their names, the documents' ids and starts ascend, however the pass before was split."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path = write_token_files(docs, shared_dir(spark))
        files = sorted(Path(path.removeprefix("file://"), "blocks").glob("*.parquet"))
        got = [r for f in files for r in sorted(read_blocks(f), key=lambda r: r[0])]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 2 and got == [r for f in files for r in read_blocks(f)]  # in order inside a file, too
    ids = [k for _, doc in got for k in doc]
    assert ids == sorted(ids) and len(ids) == docs.count()
    assert [start for start, _ in got] == sorted(start for start, _ in got)


def read_blocks(file):
    t = pq.read_table(file)
    return [(s, np.frombuffer(d, "<i8").tolist()) for s, d in zip(t["start"].to_pylist(), t["doc_ids"].to_pylist())]

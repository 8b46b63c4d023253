import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from siltstone.llm import op3_ngram_lm as lm


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (500, 700), (3000, 1 << 40), (2000, 1 << 64)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, np.uint64, endpoint=False)) if top < 1 << 64 else np.unique(rng.integers(0, 2**64, n, np.uint64))
    ef = lm.EliasFano(**lm.EliasFano.arrays(values, top))
    assert ef.n == len(values)
    if n:
        assert (ef.get(np.arange(len(values))) == values).all()
        assert (ef.find(values) == np.arange(len(values))).all()
        absent = np.setdiff1d((values + np.uint64(1)) % np.uint64(max(1, top - 1)), values)
        assert (ef.find(absent) == -1).all()


def brute(docs, shards):
    """The model from plain dictionaries; probabilities are named by a book for each group of contexts, as the files do."""
    words = lambda t: t.encode().lower().split() if t else []
    one, two, follow, types = Counter(), Counter(), Counter(), Counter()
    for k, t in docs:
        if crc32(str("" if k is None else k).encode()) % 7 == 2:
            continue
        seq = [b"\r", *words(t), b"\n"]
        one.update(seq[1:])
        two.update(zip(seq, seq[1:]))
    for (c, _), m in two.items():
        follow[c] += m
        types[c] += 1
    hashed = lambda w: int(lm.START) if w == b"\r" else int(lm.END) if w == b"\n" else lm.xxhash.xxh64_intdigest(w)
    shard = lambda c: (hashed(c) >> 20) % shards
    share, rest = {}, {}
    for s in {shard(c) for c in (*one, *follow)}:
        pairs = [(c, w) for c, w in two if shard(c) == s]
        p = np.log10(np.array([(two[x] - lm.DISCOUNT) / follow[x[0]] for x in pairs], float)).astype(np.float32)
        book = lm._book(p)
        share |= {x: 10.0 ** float(book[np.searchsorted(book, v, "right") - 1]) for x, v in zip(pairs, p)}
        own = [c for c in {*one, *follow} if shard(c) == s]
        r = np.log10(np.array([lm.DISCOUNT * types[c] / follow[c] if follow[c] else 1.0 for c in own], float)).astype(np.float32)
        book = lm._book(r)
        rest |= {c: 10.0 ** float(book[np.searchsorted(book, v, "right") - 1]) for c, v in zip(own, r)}
    n, v = sum(one.values()), len(one)
    out = []
    for k, t in docs:
        seq = [b"\r", *words(t), b"\n"]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in seq[1:])
        score = sum(math.log10(share.get((c, w), 0.0) + rest.get(c, 1.0) * (one[w] + 1) / (n + v + 1)) for c, w in zip(seq, seq[1:]))
        out.append((k, crc32(str("" if k is None else k).encode()) % 7 == 2, len(seq) - 1, sum(one[w] > 0 for w in seq[1:]), n, base, score))
    return out


def check(spark, path, docs):
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").filter("doc_id > -9").rdd.getNumPartitions())
    got = sorted(lm.op3_ngram_lm(spark, path).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(brute(docs, shards), key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for r, (k, held, n, known, total, base, score) in zip(got, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k, held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=1e-6, abs=1e-6 * n)
    return {r.doc_id: r for r in got}


def test_successors_that_share_their_bits():
    """Twins of a context keep their own counts, and a third word with the same bits is no successor."""
    c = np.array([7, 7, 7, 9], np.uint64)
    twin = np.uint64(5) << np.uint64(40)
    w = np.array([twin + np.uint64(1), twin + np.uint64(2), np.uint64(3) << np.uint64(50), twin + np.uint64(1)], np.uint64)
    shard = lm.Shard(np.frombuffer(lm.to_bytes(lm.build_shard(np.array([7, 9], np.uint64), np.array([40, 5]), c, w, np.array([1, 30, 9, 4]))), np.uint8))
    key, count, _ = shard.words(np.array([7, 7, 7, 7, 9, 8], np.uint64))
    assert key.tolist() == [0, 0, 0, 0, 1, -1] and count.tolist() == [40, 40, 40, 40, 5, 0]
    lo, hi = np.zeros(6, np.int64), np.zeros(6, np.int64)
    lo[:5], hi[:5] = shard.range_of(key[:5])
    got = shard.bigrams(key, lo, hi, np.array([w[0], w[1], w[2], twin + np.uint64(3), w[0], w[0]], np.uint64))
    assert got == pytest.approx([0.25 / 40, 29.25 / 40, 8.25 / 40, 0, 3.25 / 4, 0], rel=1e-5)


def test_against_dictionaries(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = check(spark, sf, docs)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, tables):
    docs = [(1, None), (2, ""), (3, " \t"), (4, "A a A b a"), (5, "a"), (6, "new words here"), (7, "a a a " * 5000), (8, "é É ß"), (None, "a b"), (4, "A a A b a")]
    path = tables(documents=([(k, t, "x") for k, t in docs], "doc_id long, text string, score string"))
    check(spark, path, docs)
    empty = tables(documents=([], "doc_id long, text string"))
    assert lm.op3_ngram_lm(spark, empty).count() == 0


def test_probabilities_sum_to_one_at_most(spark, tables):
    import os

    docs = [(k, "a b a c a b d " * k) for k in range(1, 9)]
    path = tables(documents=(docs, "doc_id long, text string"))
    where = f"file://{path}/model"
    shards, n, v = lm.train(spark.read.parquet(f"{path}/documents.parquet"), where)
    assert len([f for f in os.listdir(f"{path}/model") if f.endswith(".eft")]) == shards
    words = ["a", "b", "c", "d"]
    probes = [(f"{c} {w}", c, w) for c in words for w in words]
    df = spark.createDataFrame(probes, "text string, c string, w string")
    pair = {(r.c, r.w): r.score for r in lm.score_texts(df, where, shards, n, v).collect()}
    one = {r.c: r.score for r in lm.score_texts(spark.createDataFrame([(c, c) for c in words], "text string, c string"), where, shards, n, v).collect()}
    end = 1e-9
    for c in words:  # P(c w end) / P(c end) is P(w|c) P(end|w) / P(end|c); the sum of P(w|c) stays below 1
        total = 0.0
        for w in words:
            total += 10 ** (pair[c, w] - one[w]) * 10 ** first(one, w, where, shards, n, v) / 10 ** first(one, c, where, shards, n, v)
        assert total <= 1 + 1e-6 + end


def first(one, w, where, shards, n, v):
    """log10 P(w | start)."""
    shard_of = lambda h: int((h >> np.uint64(20)) % np.uint64(shards))
    s, h = lm.START, np.uint64(lm.xxhash.xxh64_intdigest(w.encode()))
    a, b = lm.Shard(lm.map_file(lm._file(where, shard_of(s)))), lm.Shard(lm.map_file(lm._file(where, shard_of(h))))
    key, _, rest = a.words(np.array([s]))
    lo, hi = a.range_of(key)
    _, count, _ = b.words(np.array([h]))
    return float(np.log10(a.bigrams(key, lo, hi, np.array([h]))[0] + rest[0] * (count[0] + 1) / (n + v + 1)))

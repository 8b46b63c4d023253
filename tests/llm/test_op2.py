import os
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import op2_toxicity as m
from siltstone.llm.op2_toxicity import fit, op2_toxicity, score_toxicity


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("toxic is not null")
    rows = got.select("score", "predicted", "toxic").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("toxic", "predicted", "score"))
    assert ((s >= 0) & (s <= 1)).all() and (p == (s >= 0.7)).all()
    hit = (p & y).sum()
    assert hit / y.sum() >= 0.9 and hit / max(1, p.sum()) >= 0.9
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    assert (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) >= 0.95


CLEAN = "the weather report says that rain will follow wind on monday morning over hills".split()


def texts():
    rng = np.random.default_rng(1)
    some = lambda: " ".join(rng.choice(CLEAN, 12))
    return [some() for _ in range(60)] + [f"{some()} {w} {some()}" for w in ("grumblord", "snotwaffle", "mudbrained") for _ in range(8)]


def test_disguised_words_and_odd_rows(spark):
    model = fit(texts(), [0] * 60 + [1] * 24)
    odd = ["you grumblord", "you gruxmblord", "you g-r-u-m-b-l-o-r-d", "you snotwaffffle", "s n o t w a f f l e", "rain on monday", "", None, "   ", "x" * 100_000, "rain on monday"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").selectExpr("*", "1D as score", "text as `we ird`")
    got = sorted(score_toxicity(df, model).collect(), key=lambda r: r.doc_id)
    assert [r.predicted for r in got] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert got[5].score == got[10].score and got[6].score == got[7].score == got[8].score
    assert score_toxicity(df.limit(0), model).columns == ["doc_id", "text", "we ird", "score", "predicted"]


def test_no_examples(spark):
    for model in (fit([], []), fit(["a clean text here"], [0])):
        df = spark.createDataFrame([(1, "anything at all")], "doc_id long, text string")
        assert [r.predicted for r in score_toxicity(df, model).collect()] == [0]


def subsequences(word):
    """Every subsequence of three letters, by counting; marks beside the letters, what lies outside them left out."""
    letter = [i for i, c in enumerate(word) if m.LETTER[ord(c)]]
    if not letter:
        return Counter()
    marked = ["begin", *word[letter[0] : letter[-1] + 1], "end"]
    code = [{"begin": m.BEGIN, "end": m.END}.get(c) or int(m.CODES[ord(c)]) for c in marked]
    out = Counter()
    for i, j, k in combinations(range(len(code)), 3):
        if k - i < m.SPAN and code[i] and code[j] and code[k]:
            out[code[i], code[j], code[k]] += m.DECAY ** (k - i + 1) * (m.FRONT if code[i] == m.BEGIN else 1)
    return out


def similarity(a, b):
    x, y = subsequences(a), subsequences(b)
    own = lambda z: sum(v * v for v in z.values()) ** 0.5
    return sum(v * y[u] for u, v in x.items()) / (own(x) * own(y)) if x and y else 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé01-.*ñ", min_size=1, max_size=9), min_size=1, max_size=6), st.lists(st.sampled_from(["abc", "cabba", "éabé", "b-a-c", "a0b1c", "aaaa"]), min_size=1, max_size=4))
def test_kernel_is_the_count_of_subsequences(words, marks):
    kernel = m.Kernel(marks, 1)
    want = np.array([[similarity(w, t) for t in marks] for w in words])
    assert np.allclose(kernel.plain(words), want, atol=1e-5)
    near = kernel.near(words)
    assert not ((want[:, 0] >= m.NEAR + 1e-5) & ~near).any()  # the bound leaves out none
    assert np.allclose(kernel(words), np.where(near[:, None], np.minimum(want, 1) ** m.POWER, 0), atol=1e-4)


def test_sentences():
    add = lambda words: np.array([[float(len(w))] for w in words], np.float32)
    v = m.Vocabulary(add, 1)
    sums, text, count = v.sentences(["aaa bbbb. cccc ccc cccc", None, "", "x y z aaa", "ab1 " * 25, "ddd"])
    assert count.tolist() == [2, 0, 0, 1, 2, 1] and text.tolist() == [0, 0, 3, 4, 4, 5]
    assert sums[:, 0].tolist() == [3 + 5, 4 + 3, 3 + 3, 0, 0, 3]  # distinct words once; x y z as one word; ab1 is too short


def test_held_out_disguises():
    """What the kernel adds: held-out toxic documents are found as well if every insult has a character put in."""
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text, toxic from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) where toxic is not null order by 1").fetchall()
    held = lambda r: crc32(str(r[0]).encode()) % 3 == 1
    model = fit([r[1] for r in rows if not held(r)], [r[2] for r in rows if not held(r)])
    scorer, rng = m.Scorer(model), random.Random(1)
    insult = re.compile("trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron", re.I)
    toxic = [r[1] for r in rows if held(r) and r[2] and insult.search(r[1])]
    for disguise in (lambda w: m.disguised(w, rng), "-".join, " ".join):
        changed = [insult.sub(lambda x: disguise(x[0]), t) for t in toxic]
        assert not any(insult.search(t) for t in changed) or disguise(" ") != " "
        assert (scorer.score(changed) >= 0.7).mean() >= 0.9


def test_nulls_clashes_and_empty_tables(spark, tables):
    docs = [(None, "a grumblord is here.", "x"), (1, None, "x"), (1, "", "x"), (2, "snotwaffle " * 3, None), (2, "snotwaffle " * 3, None)]
    labels = [(None, 1), (1, None), (2, 1), (3, 0), (3, 0), (9, 1)]
    got = op2_toxicity(spark, tables(documents=(docs, "doc_id long, text string, score string"), labels=(labels, "doc_id long, toxic int"))).collect()
    assert len(got) == 5 and {r.held_out for r in got} <= {True, False}
    assert [r.held_out for r in got if r.doc_id is None] == [crc32(b"") % 3 == 1]
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    none = op2_toxicity(spark, tables(documents=([], "doc_id long, text string, score string"), labels=(labels, "doc_id long, toxic int")))
    assert none.count() == 0 and none.columns == ["doc_id", "held_out", "score", "predicted"]


def test_toxic_passage_in_a_long_text(spark):
    model = fit(texts(), [0] * 60 + [1] * 24)
    rng = np.random.default_rng(2)
    clean = " ".join("".join(rng.choice(list("aehint"), rng.integers(4, 9))) for _ in range(20_000))  # few words come twice
    passage = "you grumblord and snotwaffle , so mudbrained ! s n o t w a f f l e and grumxblord and you mud-brained"
    middle = clean.index(" ", len(clean) // 2)
    planted = [clean, clean[:middle] + f" {passage} " + clean[middle:], f"{passage} {clean}", f"{clean} {passage}"]
    df = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    assert [r.predicted for r in sorted(score_toxicity(df, model).collect(), key=lambda r: r.doc_id)] == [0, 1, 1, 1]


def test_the_driver_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(m, "fit", lambda texts, toxic: (os.getpid(), texts, toxic))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)] + [(3, "text 0"), (None, "none"), (4, None)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(2, 1), (13, None), (None, 1), (99, 1)], "doc_id long, toxic int").repartition(3)
    pid, got, toxic = m.train(docs, labels)
    assert pid != os.getpid()
    assert sorted(got) == sorted([f"text {k}" for k in range(12)] + ["text 0"])
    by = {t: y for t, y in zip(got, toxic) if t != "text 0"}
    assert by == {f"text {k}": int(k % 2 or k == 2) for k in range(1, 12)}
    assert m.train(docs.limit(0), labels)[1:] == m.train(docs, labels.limit(0))[1:] == ([], [])

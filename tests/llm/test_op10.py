import math

import numpy as np

from siltstone.llm.op10_language_id import BITS, RANGES, Model, _grams, detect_languages, op10_language_id, train, viterbi


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op10_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


EN, DE = "the house is on the hill and we walk there with the children in the morning", "das haus steht auf dem berg und wir gehen dort mit den kindern am morgen hin"


def test_spans_and_odd_rows(spark):
    model = Model([EN, DE], ["en", "de"])
    odd = [EN, DE, f"{EN} {EN}. {DE}", None, "", "123 !?", "Привет мир", "日本語", EN * 2000, EN]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").selectExpr("*", "1 as score", "'x' as lang_pred", "2 as spans2")
    got = sorted(detect_languages(df, model, with_spans=True).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in got[:6]] == ["en", "de", "en", "und", "und", "und"]
    assert [(r.score, r.spans) for r in got[3:6]] == [(0.0, [])] * 3
    a, b = got[2].spans
    assert (a.lang, b.lang) == ("en", "de") and odd[2][b["from"] :].startswith("das haus") and b["to"] == len(odd[2])
    assert got[9].score == got[0].score
    assert detect_languages(df.limit(0), model).count() == 0


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    lens = np.array([4, 0, 6, 1])
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    got, at = viterbi(scores, lens, 0.7), 0
    for n in lens:
        own = scores[at : at + n]
        worth = lambda p: sum(own[i, s] for i, s in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(worth(p) for p in product(range(3), repeat=int(n)))
        assert abs(worth(got[at : at + n].tolist()) - best) < 1e-5
        at += n


def test_word_scores_by_counting():
    """A word's score for a language is the sum of its trigrams' smoothed log shares, less the best language's, at least -12."""
    texts, langs = [EN, DE, EN[:30]], ["en", "de", "en"]
    model = Model(texts, langs, smoothing=0.05)
    counts = {k: {} for k in ("de", "en")}
    for text, lang in zip(texts, langs):
        for w in text.split():
            for g in _grams([w])[0].tolist():
                counts[lang][g] = counts[lang].get(g, 0) + 1
    used = len({g for c in counts.values() for g in c})
    share = lambda lang, g: math.log((counts[lang].get(g, 0) + 0.05) / (sum(counts[lang].values()) + 0.05 * used))
    words = ["house", "haus", "kindern", "xyz", "the"]
    for w, got in zip(words, model.scores(words)):
        grams = _grams([w])[0].tolist()
        assert len(grams) == len(w) and all(0 <= g < 1 << BITS for g in grams)
        raw = [sum(share(k, g) if any(g in c for c in counts.values()) else 0.0 for g in grams) for k in ("de", "en")]
        assert np.allclose(got, [max(x - max(raw), -12) for x in raw], atol=1e-3), w


def test_scripts():
    names = {"a": "Latin", "é": "Latin", "ж": "Cyrillic", "α": "Greek", "ש": "Hebrew", "ع": "Arabic", "あ": "Kana", "漢": "Han", "한": "Hangul", "ก": "Thai", "अ": "Devanagari"}
    for c, want in names.items():
        assert [s for a, s in RANGES if a <= ord(c)][-1] == want, c


def test_ties_and_the_sample(spark):
    """Tied languages go to the first in order; a sample of at most so many texts is the same however the rows are dealt."""
    model = Model(["aaa bbb", "aaa bbb"], ["y", "x"])
    df = spark.createDataFrame([(1, "aaa bbb"), (2, "bbb")], "doc_id long, text string")
    assert {r.lang_pred for r in detect_languages(df, model).collect()} == {"x"}
    rows = [(k, f"wort{k} und das" if k % 3 else f"word{k} and the", "de" if k % 3 else "en") for k in range(600)] + [(None, "null key", "fr"), (700, None, "fr"), (701, "no language", None)]
    df = spark.createDataFrame(rows, "k long, t string, l string")
    a, b = (train(df.repartition(n), "t", "l", "k", 50) for n in (1, 5))
    assert a.langs == b.langs == ["de", "en"] and (a.table == b.table).all()
    assert train(df.limit(0), "t", "l", "k", 50).langs == ["und"]
    assert train(df, "t", "l", "k", 1000, most=4).langs == ["de", "en"]

import random

import pytest

from siltstone.llm import op1_decontaminate as op1
from tests.compare import assert_same


def brute(docs, items, n, t):
    words = lambda s: s.encode().lower().split() if s else []
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    best = {}
    for i, text in items:
        w = words(text)
        if not w:
            continue
        k = min(n, len(w))
        own = runs(w, k)
        for d, doc in docs:
            hit = len(own & runs(words(doc), k))
            if hit >= len(own) * t - 1e-9 and hit > best.get((d, i), (0, 0))[0]:
                best[d, i] = (hit, len(own))
    return {(d, i, q, h) for (d, i), (h, q) in best.items()}


@pytest.mark.parametrize("few", [50_000, 0])
def test_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(op1, "FEW", few)  # 0: hashes are joined by shuffle
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab Ab c\td E f g".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 6, 9, 30]))) for i in range(30)] + [(90, None), (91, " \n "), (92, "")]
    docs = [(d, text(rng.randrange(0, 40))) for d in range(60)]
    for d in range(100, 130):  # an item with a word or two replaced, inside a long text
        w = rng.choice(items[:30])[1].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        docs.append((d, text(50) + " " + " ".join(w).upper() + "\n" + text(50)))
    docs += [(200, None), (201, ""), (202, "   "), (5, "a b c d e f")]  # 5 again
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as n", "true as low")
    got = op1.find_items(d, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()} == brute(docs, items, 5, 0.8)


def test_dropped_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y", 1), (2, None, 2), (None, "a b", 3), (3, "clean text that is not there", 4), (None, "one two three four five six", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "One two THREE four five six")], "item_id long, text string")
    kept = op1.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.item_id for r in kept.collect()) == [2, 3, 4]  # two rows share the null id, and one of them holds the item
    assert op1.drop_contaminated(docs, items.limit(0)).count() == 5
    assert op1.find_items(docs.limit(0), items).count() == 0


def test_sql(spark, sf):
    assert_same(op1.op1_decontaminate(spark, sf), op1.SQL, sf)


def test_repeated_item_ids(spark):
    long = " ".join(f"w{k}" for k in range(24))  # 20 shingles, of which the document holds 10
    short = "a b c d e f g h i"  # 5 shingles, all held
    docs = spark.createDataFrame([(1, f"{short} x {' '.join(long.split()[:14])}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, long), (7, short)], "item_id long, text string")
    assert [(r.n_shingles, r.n_found, r.containment) for r in op1.find_items(docs, items).collect()] == [(5, 5, 1.0)]
    assert op1.drop_contaminated(docs, items).count() == 0

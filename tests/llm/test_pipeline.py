import hashlib
import math
from collections import Counter

import corpus_pipeline as cp
from siltstone.llm.op2_toxicity import op2_toxicity

from .test_op1 import brute as contaminated
from .test_op5 import expected
from .test_op9 import brute as grouped

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, taken int, h string, key string, `we ird` int"


def least_of_groups(docs):
    """Rows (number, id, text) of which one stays for each group: the least id, nulls last, the first row of several."""
    group = {k: g for k, _, g in grouped([(i, t) for i, (_, _, t) in enumerate(docs)], 5, 80)}
    best = {}
    for i, (n, k, _) in enumerate(docs):
        best[group[i]] = min(best.get(group[i], (True, math.inf, math.inf)), (k is None, k if k is not None else 0, n))
    return {b[2] for b in best.values()}


def mixed(docs):
    """How often each row (id, text, source) is taken: weights 3, 1, 2, at most twice, cut where the words reach the budget."""
    size = lambda t: len(t.encode().split()) if t else 0
    h = lambda k, t: hashlib.md5(f"{'' if k is None else k}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s))
    words = {s: sum(size(t) for _, t, own in docs if own == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(words.values())
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] >= 2 * words[s]}
        if not full:
            break
        target |= {s: 2.0 * words[s] for s in full}
        left, open_ = left - sum(target[s] for s in full), open_ - full
    target |= {s: level * weight[s] for s in open_}
    turns = []
    for s in sources:
        end = 0
        for i in sorted((i for i, d in enumerate(docs) if d[2] == s), key=lambda i: (h(*docs[i][:2]), docs[i][0] is not None, docs[i][0] or 0)):
            end += size(docs[i][1])
            turns += [((end + lap * words[s]) / target[s], h(*docs[i][:2]), docs[i][0] is not None, docs[i][0] or 0, lap, i) for lap in (0, 1) if target[s]]
    taken, total, budget = Counter(), 0, math.floor(sum(target.values()) + 1e-6)
    for *_, i in sorted(turns):
        total += size(docs[i][1])
        if total <= budget:
            taken[i] += 1
    return taken


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages, columns = dict(cp.STAGES), docs.columns
    assert list(stages) == ["toxicity", "near_dedup", "decontaminate", "mix", "token_files"]

    def run(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), sf)
        assert out.columns == columns
        return [tuple(r) for r in out.collect()]

    rows = [tuple(r) for r in docs.collect()]
    toxic = {r.doc_id for r in op2_toxicity(spark, sf).collect() if r.predicted}
    kept = run("toxicity", rows)
    assert sorted(kept) == sorted(r for r in rows if r[0] not in toxic)
    stay = least_of_groups([(i, r[0], r[1]) for i, r in enumerate(kept)])
    unique = run("near_dedup", kept)
    assert sorted(unique) == sorted(r for i, r in enumerate(kept) if i in stay)
    bad = {d for d, _, _, _ in contaminated([(r[0], r[1]) for r in unique], benchmark, 5, 0.8)}
    clean = run("decontaminate", unique)
    assert sorted(clean) == sorted(r for r in unique if r[0] not in bad)
    at = {c: columns.index(c) for c in ("doc_id", "text", "source")}
    taken = mixed([(r[at["doc_id"]], r[at["text"]], r[at["source"]]) for r in clean])
    mix = run("mix", clean)
    assert Counter(mix) == Counter({clean[i]: n for i, n in taken.items() if n})
    files = stages["token_files"](spark, spark.createDataFrame(mix, docs.schema), sf)
    want = expected(sorted(((r[0], r[1]) for r in mix), key=lambda r: r[0]))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in files.collect()) == sorted(want)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in cp.run(spark, sf).collect()) == sorted(want)


def test_odd_rows_in_every_stage(spark, sf):
    """Null and repeated ids, nulls in every column, empty and very long texts, and columns named like a stage's own."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 60").first().text
    words = lambda n, seed: " ".join(hashlib.md5(f"{seed} {i}".encode()).hexdigest()[:5] for i in range(n))
    extra = ("en", "a", 9, 99.5, "as it was", 7, "x", "y", 3)
    none = (None,) * 9
    rows = [
        (1, words(40, 1), *extra), (1, words(40, 1), *extra), (1, words(40, 2), *extra),  # an id twice with one text, once with another
        (None, words(40, 3), *extra), (None, words(40, 3), *none), (None, words(40, 4), *none), (None, f"{words(9, 5)} {item}", *extra),  # one contaminated null id among clean ones
        (7, None, *extra), (7, "", *none), (8, " \n ", *extra), (9, words(200_000, 6), *extra), (10, "short", *extra), (None, None, *none),
    ]
    before = spark.createDataFrame(rows, SCHEMA)
    stages = dict(cp.STAGES)
    got = stages["toxicity"](spark, before, sf)
    assert got.schema.names == before.schema.names and Counter(map(tuple, got.collect())) == Counter(rows)
    got = stages["near_dedup"](spark, before, sf)
    assert got.schema.names == before.schema.names
    left = Counter(map(tuple, got.collect()))
    assert sum(left.values()) == len(rows) - 2 and left[rows[0]] == 1 and left[rows[2]] == 1
    assert left[rows[3]] + left[rows[4]] == 1 and all(left[r] == 1 for r in rows[5:])
    got = stages["decontaminate"](spark, before, sf)
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r is not rows[6])
    got = stages["mix"](spark, before, sf)
    assert got.schema.names == before.schema.names
    taken = mixed([(r[0], r[1], r[3]) for r in rows])
    assert Counter((r.text or "")[:30] for r in got.collect()) == Counter((rows[i][1] or "")[:30] for i, n in taken.items() for _ in range(n))
    files = stages["token_files"](spark, before, sf)
    assert files.count() == len(rows)


def test_no_documents(spark, sf):
    for _, stage in cp.STAGES:
        assert stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0

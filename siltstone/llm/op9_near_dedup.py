"""Near-duplicate documents: bottom-k sketches of shingle hashes, inverted lists, exact Jaccard.

1. Documents with the same words in the same order are a class; one row of it stands for it from here on.
2. A sketch holds the k least hashes of a document's shingles, all under one hash function. Two documents with
   similarity >= t share at least c of their retained values, c lying 6.4 standard deviations below k * t (sets that fit
   into a sketch need t of themselves: no chance there). So, with a sketch's values in order of how many sketches hold
   them, rarest first, they share one of the first size - c + 1, and only these go to the inverted lists: what many
   different documents have in common is not what lists are made of.
3. Each list has a hub, the one of its documents whose values are the most common. Documents are paired with the hubs
   of their lists; pairs pass if their union's bottom k holds c common values, and become links if the exact Jaccard
   reaches t.
4. Documents that share a list share its hub. Where a hub's documents are still in several components, those outside the
   hub's component are compared with all the others, block by block: a block pair's exact intersections are a matrix
   product, and it gives no more links than it takes to join its components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import small
from .common import Grown, Ids, lean, saved, slices, table, with_row_key, words
from .graph import components

K = 64
#: Documents of a hub compared with as many others at a time, and columns of a matrix product.
BLOCK, COLUMNS = 256, 4096
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct 64-bit hashes, ascending, of a text's runs of n words; keeps the hashes of words it has met."""

    def __init__(self, n: int):
        self.n, self.ids, self.hashes = n, Ids(), Grown(np.uint64)

    def many(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The sets of texts given as words; new words are hashed once for all of them."""
        if self.ids.full:
            self.ids, self.hashes = Ids(), Grown(np.uint64)
        rows = [self.ids.of(t) for t in texts]
        new = len(self.ids) - self.hashes.n
        if new:
            self.hashes.extend(np.fromiter(map(xxhash.xxh64_intdigest, islice(self.ids, self.hashes.n, None)), np.uint64, new))
        h = self.hashes.view[np.concatenate(rows)] if rows else np.empty(0, np.uint64)
        whole = self._runs(h, self.n) if len(h) >= self.n else h[:0]
        out, at = [], 0
        for r in rows:
            m = len(r)
            if m >= self.n:
                out.append(np.unique(whole[at : at + m - self.n + 1]))
            else:
                out.append(self._runs(h[at : at + m], m) if m else h[:0])
            at += m
        return out

    @staticmethod
    def _runs(h: np.ndarray, n: int) -> np.ndarray:
        m = len(h) - n + 1
        out = np.full(m, n, np.uint64)
        for k in range(n):
            out = _mix((out + STEP) ^ h[k : k + m])
        return out


def class_key(tokens: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(tokens), digest_size=16).digest()


def least_common(k: int, t: float) -> int:
    return max(1, math.floor(k * t - 6.4 * math.sqrt(k * t * (1 - t))))


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """doc_id, file and row of each row, the key of its word sequence (null without words), n_shingles and the k least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for big in batches:
            for batch in slices(big, "text"):
                tokens = [words(text.as_py()) for text in batch.column("text")]
                sets = shingles.many(tokens)
                keys = [class_key(t) if t else None for t in tokens]
                sizes = [len(s) for s in sets]
                least = [s[:k].view(np.int64) for s in sets]
                own = [batch.column(c) for c in ("doc_id", "__file", "__row")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "file", "row", "key", "n_shingles", "sketch"])

    return lean(docs).mapInArrow(run, "doc_id long, file long, row long, key binary, n_shingles long, sketch array<long>")


def _enough(a: np.ndarray, b: np.ndarray, na: int, nb: int, k: int, t: float) -> bool:
    """Whether the bottom k of two sketches' union has as many common values as pairs of similarity t have."""
    union = np.union1d(a.view(np.uint64), b.view(np.uint64))
    if na < k and nb < k:
        common = len(a) + len(b) - len(union)
        return common >= t * len(union) - 1e-9
    if len(union) < k:
        return True
    top = union[k - 1]
    au, bu = a.view(np.uint64), b.view(np.uint64)
    common = np.searchsorted(au, top, "right") + np.searchsorted(bu, top, "right") - k
    return bool(common >= least_common(k, t))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, k: int, t: float) -> DataFrame:
    """Those pairs (a, b) of class ids whose exact Jaccard reaches t."""
    percent = round(t * 100)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            sa, sb = batch.column(4), batch.column(5)
            keep = [i for i in range(batch.num_rows) if _enough(sa[i].values.to_numpy(), sb[i].values.to_numpy(), na[i], nb[i], k, t)]
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                own: dict[int, list[bytes]] = {}
                for c in "ab":
                    for rep, text in zip(batch.column(c).to_pylist(), batch.column(f"t{c}")):
                        if rep not in own:
                            own[rep] = words(text.as_py())
                sets = dict(zip(own, shingles.many(list(own.values()))))
                keep = []
                for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                    p, q = sets[x], sets[y]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * common >= percent * (len(p) + len(q) - common):
                        keep.append(i)
                yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    near = saved(met.mapInArrow(estimate, "a long, b long"))
    texts = _texts(near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))), reps, docs)
    met = near.join(texts.withColumnRenamed("rep", "a").withColumnRenamed("text", "ta"), "a").join(texts.withColumnRenamed("rep", "b").withColumnRenamed("text", "tb"), "b").select("a", "b", "ta", "tb")
    return met.mapInArrow(exact, "a long, b long").distinct()


def _texts(some: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """rep and text of the classes named in `some`, each once, taken from the row that stands for the class."""
    places = reps.join(some.select("rep").distinct(), "rep", "left_semi").select("rep", "file", "row")
    return docs.join(places, (docs["__file"] == places["file"]) & (docs["__row"] == places["row"])).select("rep", "text")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links are pairs with Jaccard >= threshold of n-word shingles.

    A text with fewer than n words is one shingle. Null, empty and wordless texts have n_shingles 0 and are linked with
    nothing; a row with a null id has a null component and is kept, though its text may link others. component_id is the
    least id reachable by links, kept says whether it is the row's own; rows that repeat an id with one text agree. Copies
    are linked through their class, so a class of any size costs a row each. A hub's documents are compared in blocks, so
    no task holds all of them.
    """
    every, components_of = _grouped(df, doc_id, text, n, threshold, k)
    least = components_of.filter("least is not null").groupBy("component").agg(F.min("least").alias("least"))
    classes = components_of.select("key", "component").join(least, "component", "left").select("key", "least")
    out = every.select("doc_id", "key", "n_shingles").join(classes, "key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, k: int = K) -> DataFrame:
    """The rows, all columns, of which one stays for each group of near duplicates: the least id, nulls last, and of several
    such rows the first in the files. Rows are told apart by their place, so repeated and null ids do no harm. Rows without
    words are in no group and stay. Empty tables give no rows."""
    keyed = with_row_key(df)
    every, components_of = _grouped(keyed, doc_id, text, n, threshold, k)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    member = every.filter("key is not null").select("key", place.alias("p"))
    first = member.groupBy("key").agg(F.min("p").alias("p"))  # of each text, where copies are
    first = first.join(components_of.select("key", "component"), "key").groupBy("component").agg(F.min("p").alias("p")).select("p.file", "p.row")
    stay = first.unionByName(every.filter("key is null").select("file", "row"))
    return keyed.join(stay, (keyed["__file"] == stay["file"]) & (keyed["__row"] == stay["row"]), "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def _grouped(df: DataFrame, doc_id: str, text: str, n: int, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and of each class of equal word sequences its key, component and least id."""
    keyed = df if "__row" in df.columns else with_row_key(df)
    docs = keyed.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), "__file", "__row")
    every = saved(sketches(docs, n, k))
    reps = every.filter("key is not null").groupBy("key").agg(F.min(F.struct("file", "row", "n_shingles", "sketch")).alias("r"), F.min("doc_id").alias("least"))
    reps = saved(reps.select(F.monotonically_increasing_id().alias("rep"), "key", "r.*", "least"))  # numbered once, as written
    c = least_common(k, threshold)
    size = F.size("sketch")
    need = F.when(F.col("n_shingles") <= threshold * (k + 1) - 1, F.ceil(threshold * size - 1e-9)).otherwise(F.lit(c))
    held = reps.select("rep", F.col("n_shingles").alias("n"), (size - need + 1).cast("int").alias("first"), size.alias("size"), F.explode("sketch").alias("v"))
    often = held.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    shared = held.join(often, "v")
    lists = shared.groupBy("rep").agg(
        F.first("n").alias("n"), (F.first("first") - F.first("size") + F.count("*")).alias("first"), F.sum("df").alias("popular"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs")
    )  # at most k values each; values that no other sketch has come first and are done with
    lists = lists.filter("first > 0").select("rep", "n", (F.col("popular") / F.size("vs")).alias("popular"), F.explode(F.slice("vs", F.lit(1), F.col("first").cast("int"))).alias("x"))
    lists = saved(lists.select("rep", "n", "popular", F.col("x.v").alias("v")))
    hub = lists.groupBy("v").agg(F.max(F.struct("popular", (-F.col("rep")).alias("rep"), "n")).alias("h"), F.count("*").alias("m")).filter("m > 1")
    near = F.least("n", "h.n") >= threshold * F.greatest("n", "h.n") - 1e-9
    groups = saved(lists.join(hub, "v").select((-F.col("h.rep")).alias("hub"), "rep", near.alias("near")).distinct())
    first = groups.filter("near and rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = saved(_verified(first, reps, docs, n, k, threshold))
    so_far = saved(components(links))
    of = lambda c: so_far.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    left = groups.join(of("rep"), "rep", "left").join(of("hub"), "hub", "left")
    left = left.select("hub", "rep", F.coalesce("rep_component", "rep").alias("component"), F.coalesce("rep_component", "rep").eqNullSafe(F.coalesce("hub_component", "hub")).alias("inner"))
    links = saved(links.unionByName(_joined(left, reps, docs, n, threshold)))
    found = components(links).withColumnRenamed("id", "rep")
    return every, saved(reps.select("key", "rep", "least").join(found, "rep", "left").select("key", "least", F.coalesce("component", "rep").alias("component")))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches in runs of equal first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for x in keys:
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(x[a] for x in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _joined(left: DataFrame, reps: DataFrame, docs: DataFrame, n: int, t: float) -> DataFrame:
    """Links (a, b) that join components of hubs' documents: rows of (hub, rep, component, inner: of the hub's component).

    Blocks of the documents that are not inner meet each other and the blocks of those that are. A task holds two blocks.
    """
    percent = round(t * 100)
    left = saved(left)  # so that a hub's rows are split where it is joined, which they can't be where it is counted
    many = saved(left.groupBy("hub").agg(F.count_if("inner").alias("g"), F.count_if(~F.col("inner")).alias("o")).filter("o > 0"))
    left = left.join(small(many.select("hub", F.ceil(F.col("g") / BLOCK).cast("int").alias("gb"), F.ceil(F.col("o") / BLOCK).cast("int").alias("ob"))), "hub")
    texts = _texts(left, reps, docs)
    left = left.withColumn("c", F.pmod(F.xxhash64("rep"), F.when(F.col("inner"), F.col("gb")).otherwise(F.col("ob"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    among = F.transform(upto("ob"), lambda d: place(F.least("c", d), F.col("gb") + F.greatest("c", d)))
    inner = F.when(F.col("gb") > 0, F.transform(upto("gb"), lambda j: place(F.col("c"), j)))
    places = F.when(F.col("inner"), F.transform(upto("ob"), lambda x: place(x, F.col("c")))).otherwise(F.concat(F.coalesce(inner, F.array().cast("array<struct<x:int,y:int>>")), among))
    rows = left.join(texts, "rep").withColumn("at", F.explode(places)).select("hub", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "c", "inner", "gb", "rep", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for group in _runs(batches, 3):
            a, b = _forest(group, shingles, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y", "rep").mapInArrow(run, "a long, b long")


def _forest(group: pa.Table, shingles: Shingles, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a block pair that together join all the components that its links join."""
    x, y, gb = (group.column(c)[0].as_py() for c in ("x", "y", "gb"))
    c, inner = group.column("c").to_numpy(), group.column("inner").to_numpy()
    row = ~inner & (c == x)
    column = inner if y < gb else ~inner & (c == y - gb)
    if not row.any() or not column.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tokens = [words(text) for text in group.column("text").to_pylist()]
    row, column = np.flatnonzero(row), np.flatnonzero(column)
    sets = shingles.many(tokens)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    doc = np.repeat(np.arange(len(sets)), size)
    often = times > 1
    place = (np.cumsum(often) - 1)[value]
    some = often[value]
    place, doc = place[some], doc[some]
    order = np.argsort(place, kind="stable")
    place, doc = place[order], doc[order]
    common = np.zeros((len(row), len(column)), np.float32)
    for at in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[doc[lo:hi], place[lo:hi] - at] = 1
        common += has[row] @ has[column].T
    rep, component = group.column("rep").to_numpy(), group.column("component").to_numpy()
    linked = 100 * common >= percent * (size[row][:, None] + size[column][None, :] - common)
    linked &= component[row][:, None] != component[column][None, :]
    i, j = np.nonzero(linked)
    a, b = row[i], column[j]
    pair = np.stack([np.minimum(component[a], component[b]), np.maximum(component[a], component[b])])
    _, first = np.unique(pair, axis=1, return_index=True)
    above: dict[int, int] = {}

    def top(z: int) -> int:
        while z in above:
            z = above[z]
        return z

    kept = []
    for k in first.tolist():
        p, q = top(int(component[a[k]])), top(int(component[b[k]]))
        if p != q:
            above[p] = q
            kept.append(k)
    return rep[a[kept]], rep[b[kept]]


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, links at 85 percent of three-word shingles.

    Null, empty and wordless texts have 0 shingles and are their own component; a null id has a null component and is kept;
    repeated rows get a row each; no documents give no rows.
    """
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), n=3, threshold=0.85)

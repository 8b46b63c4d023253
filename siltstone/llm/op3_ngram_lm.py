"""Language-model scoring with a memory-mapped Elias-Fano trie of word bigrams.

Words are 64-bit hashes. The model is dealt into shards by the hash of a context word; a shard is one file that holds
 * keys: the hashes of its words, ascending, as an Elias-Fano sequence, the running sum of their exact counts as another,
   and a byte for each that names one of 256 discount masses of the shard;
 * pointers: for each key, where its successors begin, as an Elias-Fano sequence;
 * successors: the number of the context, then 40 bits of the next word's hash, as an Elias-Fano sequence (relative to its
   context a successor is 40 bits; the context's number makes the whole ascend), and a byte for each that names one of 256
   discounted probabilities of the shard. Where two successors of a context share the 40 bits, both stay, and a small
   table of whole hashes tells them apart.
A bigram is looked up by finding its context's key and then searching its successors between two pointers. A word that
never follows a context is taken for one of its t successors with a chance of t / 2**40. Probabilities are interpolated: P(w | c) = max(n(c, w) - D, 0) / n(c) + D * t(c) / n(c) * (n(w) + 1) / (N + V + 1), where t(c) is the
number of distinct successors of c; a context that is not known leaves the second factor alone.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Grown, Ids, fold, lean, shared_dir, slices, table, words

DISCOUNT = 0.75
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\r\n", b"\n"))  # no word is either
TOP = 40  # bits kept of a successor's hash
#: Tokens a worker counts before it hands the counts on.
TOKENS = 3_000_000

BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th one in a byte.
BYTE_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        BYTE_SELECT[_b, _k] = _i


class EliasFano:
    """An ascending sequence: low bytes of each number, and its high part in unary, a one for each number."""

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = max(1, len(values))
        low = -(-max(0, (universe // n).bit_length() - 1) // 8)
        high = (values >> np.uint64(8 * low)) if low < 8 else np.zeros_like(values)
        bits = np.zeros(int((universe >> (8 * low)) + len(values) + 1) // 8 + 1, np.uint8)
        at = high.astype(np.int64) + np.arange(len(values))
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        ones = np.concatenate([[0], np.cumsum(BYTE_ONES[bits], dtype=np.int64)])[:: 1].astype(np.uint32)
        planes = values[:, None].view(np.uint8).reshape(len(values), 8)[:, :low] if len(values) else np.zeros((0, low), np.uint8)
        return {"bits": bits, "ones": ones[::8].copy(), "low": np.ascontiguousarray(planes)}

    def __init__(self, bits: np.ndarray, ones: np.ndarray, low: np.ndarray):
        self.bits, self.ones, self.low, self.n = bits, ones, low, len(low)
        self.shift = np.uint64(8 * low.shape[1])

    def lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low.shape[1]):
            out |= self.low[i, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def _select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Place of the i-th one, or zero, of the unary part."""
        ones = self.ones.astype(np.int64)
        count = ones if one else 64 * np.arange(len(ones), dtype=np.int64) - ones
        block = np.searchsorted(count, i, "right") - 1
        left = i - count[block]
        byte = block * 8
        todo = np.arange(len(i))
        top = len(self.bits) - 1
        for _ in range(8):
            b = self.bits[np.minimum(byte[todo], top)]
            c = BYTE_ONES[b].astype(np.int64)
            if not one:
                c = 8 - c
            more = left[todo] >= c
            todo = todo[more]
            if not len(todo):
                break
            left[todo] -= c[more]
            byte[todo] += 1
        b = self.bits[np.minimum(byte, top)]
        return byte * 8 + BYTE_SELECT[b if one else 255 - b, np.minimum(left, 7)]

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << self.shift) | self.lows(i)

    def find(self, values: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each value between lo and hi, the first if it comes several times, or -1."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        high = (values >> self.shift).astype(np.int64)
        lo = np.maximum(lo, np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0))
        hi = np.minimum(self.n if hi is None else hi, self._select(high, False) - high)
        return search(self.lows, lo, hi, values & np.uint64((1 << int(self.shift)) - 1))


def search(value_at, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Binary search of each wanted value between lo and hi; -1 where it isn't."""
    lo, end = lo.copy(), hi.copy()
    todo = np.flatnonzero(lo < end)
    while len(todo):
        mid = (lo[todo] + end[todo]) >> 1
        less = value_at(mid) < wanted[todo]
        lo[todo[less]] = mid[less] + 1
        end[todo[~less]] = mid[~less]
        todo = todo[lo[todo] < end[todo]]
    out = np.full(len(lo), -1, np.int64)
    some = np.flatnonzero(lo < hi)
    out[some] = np.where(value_at(lo[some]) == wanted[some], lo[some], -1)
    return out


def _book(p: np.ndarray) -> np.ndarray:
    """At most 256 values: an even grid of the likely ones, and quantiles of the distinct ones below it."""
    kinds = np.unique(p)
    if len(kinds) <= 256:
        return kinds if len(kinds) else np.zeros(1, np.float32)
    grid = np.linspace(-2, 0, 129)[:-1].astype(np.float32)
    below = kinds[kinds < grid[0]]
    tail = np.quantile(below, np.linspace(0, 1, 127), method="lower") if len(below) else kinds[:1]
    return np.unique(np.concatenate([tail, grid[grid >= kinds[0]]])).astype(np.float32)


def _named(p: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each value the number of the book's next smaller one, so that sums of probabilities stay below 1."""
    return np.clip(np.searchsorted(book, p, "right") - 1, 0, 255).astype(np.uint8)


def build_shard(keys: np.ndarray, counts: np.ndarray, c: np.ndarray, w: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Levels of a shard from its words' counts and its contexts' bigrams; equal rows are summed."""
    keys, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, counts, minlength=len(keys)).astype(np.int64)
    order = np.lexsort((w, c))
    c, w, n = c[order], w[order], n[order]
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    n = np.add.reduceat(n, np.flatnonzero(first)) if len(n) else n
    c, w = c[first], w[first]
    # the start of a text is a context but no word
    extra = np.setdiff1d(c, keys)
    keys, total = np.concatenate([keys, extra]), np.concatenate([total, np.zeros(len(extra), np.int64)])
    order = np.argsort(keys)
    keys, total = keys[order], total[order]
    of = np.searchsorted(keys, c)
    types = np.bincount(of, minlength=len(keys))
    followed = np.bincount(of, n, minlength=len(keys))
    p = np.log10((n - DISCOUNT) / np.maximum(followed[of], 1)).astype(np.float32)
    rest = np.log10(np.where(followed > 0, DISCOUNT * types / np.maximum(followed, 1), 1.0)).astype(np.float32)
    book, rests = _book(p), _book(rest)
    ends = np.concatenate([[0], np.cumsum(types)]).astype(np.uint64)
    sums = np.concatenate([[0], np.cumsum(total)]).astype(np.uint64)
    # both orders are the same, for a hash's top bits come first; a shard has fewer than 2**24 contexts
    value = (of.astype(np.uint64) << np.uint64(TOP)) | (w >> np.uint64(64 - TOP))
    twin = np.zeros(len(value), bool)
    if len(value):
        twin[1:] = value[1:] == value[:-1]
        twin[:-1] |= twin[1:]
    at = np.flatnonzero(twin)
    out = {f"key_{k}": v for k, v in EliasFano.arrays(keys, 1 << 64).items()}
    out |= {f"ptr_{k}": v for k, v in EliasFano.arrays(ends, int(len(c)) + 1).items()}
    out |= {f"sum_{k}": v for k, v in EliasFano.arrays(sums, int(sums[-1]) + 1).items()}
    out |= {f"succ_{k}": v for k, v in EliasFano.arrays(value, max(1, len(keys)) << TOP).items()}
    return out | {"rest": _named(rest, rests), "rests": rests, "code": _named(p, book), "book": book, "twin_at": at.astype(np.int64), "twin": w[at], "n": np.array([total.sum(), (total > 0).sum()], np.int64)}


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    head, parts, at = {}, [], 0
    for name, a in arrays.items():
        raw = a.tobytes()
        head[name] = (a.dtype.str, a.shape, at)
        parts += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *parts])


class Shard:
    """A shard's levels over a mapped file."""

    def __init__(self, data: np.ndarray):
        size = int(data[:8].view("<u8")[0])
        head = json.loads(data[8 : 8 + size].tobytes())
        part = {}
        for name, (dtype, shape, at) in head.items():
            dt = np.dtype(dtype)
            begin = 8 + size + at
            part[name] = data[begin : begin + dt.itemsize * int(np.prod(shape))].view(dt).reshape(shape)
        self.keys, self.ptr, self.sums, self.succ = (EliasFano(part[f"{k}_bits"], part[f"{k}_ones"], part[f"{k}_low"]) for k in ("key", "ptr", "sum", "succ"))
        self.rest, self.rests, self.code, self.book, self.twin_at, self.twin = (part[k] for k in ("rest", "rests", "code", "book", "twin_at", "twin"))

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its key or -1, count, and the mass its discounts leave."""
        at = self.keys.find(h)
        known = at >= 0
        count, rest = np.zeros(len(h), np.int64), np.ones(len(h), np.float32)
        some = at[known]
        count[known] = (self.sums.get(some + 1) - self.sums.get(some)).astype(np.int64)
        rest[known] = np.float32(10.0) ** self.rests[self.rest[some]]
        return at, count, rest

    def range_of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ptr.get(key).astype(np.int64), self.ptr.get(key + 1).astype(np.int64)

    def bigrams(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Discounted probability of each word as a successor of a key, whose range is given; 0 if it is none."""
        wanted = (np.maximum(key, 0).astype(np.uint64) << np.uint64(TOP)) | (w >> np.uint64(64 - TOP))
        at = np.full(len(w), -1, np.int64)
        some = np.flatnonzero((key >= 0) & (lo < hi))
        at[some] = self.succ.find(wanted[some], lo[some], hi[some])
        if len(self.twin_at) and len(at):
            first = np.searchsorted(self.twin_at, at)
            for k in np.flatnonzero((first < len(self.twin_at)) & (self.twin_at[np.minimum(first, len(self.twin_at) - 1)] == at) & (at >= 0)):
                j, found = first[k], -1  # the first of the successors that share the bits
                while j < len(self.twin_at) and self.twin_at[j] == at[k] + (j - first[k]) and (self.twin[j] >> np.uint64(64 - TOP)) == (w[k] >> np.uint64(64 - TOP)):
                    found = self.twin_at[j] if self.twin[j] == w[k] else found
                    j += 1
                at[k] = found
        out = np.zeros(len(w))
        some = at >= 0
        out[some] = 10.0 ** self.book[self.code[at[some]]].astype(float)
        return out


def _file(path: str, k: int) -> str:
    return f"{path}/shard-{k:06d}.eft"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the name in it; s3a is the name that Spark gives to s3."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


def write_file(path: str, data: bytes) -> None:
    """Whole or not at all, so that a task that runs twice does no harm."""
    fs, name = _place(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"  # of this attempt alone, wherever it runs
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, name)


def map_file(path: str) -> np.ndarray:
    fs, name = _place(path)
    if fs.type_name == "local":
        return np.memmap(name, np.uint8, "r")
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), np.uint8)


def _hash_new(ids: Ids, hashes: Grown) -> None:
    if len(ids) > hashes.n:
        hashes.extend(np.fromiter(map(xxhash.xxh64_intdigest, islice(ids, hashes.n, None)), np.uint64, len(ids) - hashes.n))


def _tokens(text: str | None, ids: Ids) -> np.ndarray:
    """Numbers of a text's words, and 1 for the end; 0 is the start."""
    own = words(text)
    out = np.ones(len(own) + 1, np.int64)
    out[:-1] = ids.of(own)
    return out


def _fresh() -> tuple[Ids, Grown]:
    hashes = Grown(np.uint64)
    hashes.extend(np.array([START, END], np.uint64))
    return Ids({b"\r\n": 0, b"\n": 1}), hashes


def train(df: DataFrame, path: str, text: str = "text") -> tuple[int, int, int]:
    """Writes the model of all the texts to a folder that executors share; gives shards, N and V.

    Each task adds up its own counts and sends each shard one row of packed counts, so frequent words and bigrams travel
    once a task; shards follow the shuffle's partitions. A lost task is run again and replaces its file.
    """
    spark = df.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes = _fresh()
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            _hash_new(ids, hashes)
            h = hashes.view
            token = np.concatenate(held)
            before = np.empty_like(token)
            before[1:] = token[:-1]
            before[0] = 0
            before[before == 1] = 0  # after an end comes a start
            pair, times = np.unique(before * len(h) + token, return_counts=True)
            c, w = h[pair // len(h)], h[pair % len(h)]
            own, freq = np.unique(token, return_counts=True)
            deal = lambda x: ((x >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            for kind, by, cols in ((0, deal(h[own]), (h[own], freq.astype(np.uint32))), (1, deal(c), (c, w, times.astype(np.uint32)))):
                order = np.argsort(by, kind="stable")
                edges = np.searchsorted(by[order], np.arange(shards + 1))
                cols = [x[order] for x in cols]
                for s in range(shards):
                    a, b = edges[s], edges[s + 1]
                    if b > a:
                        parts = [x[a:b] for x in cols]
                        if kind:  # contexts once each, with how many successors follow
                            first = np.ones(b - a, bool)
                            first[1:] = parts[0][1:] != parts[0][:-1]
                            start = np.flatnonzero(first)
                            parts = [parts[0][start], np.diff(start, append=b - a).astype(np.uint32), *parts[1:]]
                        small = parts[-1] if parts[-1].max() > 255 else parts[-1].astype(np.uint8)
                        parts[-1] = small
                        raw = [x.tobytes() for x in parts]
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([kind], pa.int32()), pa.array([len(parts[0])], pa.int64()), pa.array([b - a], pa.int64()), pa.array([b"".join(raw)], pa.binary())], names=["shard", "kind", "m", "n", "data"])

        for batch in batches:
            for t in batch.column(0):
                held.append(_tokens(t.as_py(), ids))
                n += len(held[-1])
                if n > TOKENS:
                    yield from flush()
                    held, n = [], 0
                    if ids.full:
                        ids, hashes = _fresh()
        if held:
            yield from flush()

    def unpack(kind: int, m: int, n: int, data: bytes) -> list[np.ndarray]:
        sizes = [(np.uint64, m)] if kind == 0 else [(np.uint64, m), (np.uint32, m), (np.uint64, n)]
        out, at = [], 0
        for dt, k in sizes:
            out.append(np.frombuffer(data, dt, k, at))
            at += out[-1].nbytes
        out.append(np.frombuffer(data, np.uint8 if len(data) - at == n else np.uint32, n, at).astype(np.int64))
        return [out[0], out[1]] if kind == 0 else [np.repeat(out[0], out[1]), out[2], out[3]]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(shard: int, rows: list) -> pa.RecordBatch:
            one = [unpack(*r) for r in rows if r[0] == 0]
            two = [unpack(*r) for r in rows if r[0] == 1]
            cols = [np.concatenate([r[k] for r in one]) if one else np.empty(0, np.uint64 if k == 0 else np.int64) for k in range(2)]
            cols += [np.concatenate([r[k] for r in two]) if two else np.empty(0, np.uint64 if k < 2 else np.int64) for k in range(3)]
            levels = build_shard(*cols)
            write_file(_file(path, shard), to_bytes(levels))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(levels["n"][0])], pa.int64()), pa.array([int(levels["n"][1])], pa.int64())], names=["shard", "n", "v"])

        last, rows = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                shard, kind, m, n, data = (batch.column(k)[r].as_py() for k in range(5))
                if shard != last and rows:
                    yield finish(last, rows)
                    rows = []
                last = shard
                rows.append((kind, m, n, data))
        if rows:
            yield finish(last, rows)

    packed = lean(df).select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "shard int, kind int, m long, n long, data binary")
    built = packed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, n long, v long").collect()  # a row per shard
    there = {r["shard"] for r in built}
    for k in range(shards):
        if k not in there:
            e = np.empty(0, np.uint64)
            write_file(_file(path, k), to_bytes(build_shard(e, np.empty(0, np.int64), e, e, np.empty(0, np.int64))))
    return shards, sum(r["n"] for r in built), sum(r["v"] for r in built)


_SHARDS: dict[str, Shard] = {}


def _shard(path: str, k: int) -> Shard:
    name = _file(path, k)
    if name not in _SHARDS:
        if _SHARDS and not next(iter(_SHARDS)).startswith(path):
            _SHARDS.clear()
        _SHARDS[name] = Shard(map_file(name))
    return _SHARDS[name]


def score_texts(df: DataFrame, path: str, shards: int, n_all: int, v_all: int, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to each row; the text column is dropped.

    Null and empty texts consist of the end alone. Scores are log10 probabilities of whole texts. With an empty model
    every token has probability 1. Columns named like an output are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [f for f in df.schema.fields if f.name not in (*new, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes = _fresh()
        word = {"key": Grown(np.int64), "count": Grown(np.int64), "rest": Grown(np.float32), "lo": Grown(np.int64), "hi": Grown(np.int64)}
        deal = lambda h: ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)

        def learn() -> None:
            _hash_new(ids, hashes)
            h = hashes.view[word["key"].n :]
            got = {k: np.zeros(len(h), g.data.dtype) for k, g in word.items()}
            for s, at in _groups(deal(h)):
                shard = _shard(path, s)
                key, got["count"][at], got["rest"][at] = shard.words(h[at])
                got["key"][at] = key
                some = at[key >= 0]
                got["lo"][some], got["hi"][some] = shard.range_of(key[key >= 0])
            for k, g in word.items():
                g.extend(got[k])

        for big in batches:
            for batch in slices(big, big.num_columns - 1):
                if ids.full:
                    ids, hashes = _fresh()
                    word = {k: Grown(g.data.dtype) for k, g in word.items()}
                rows = [_tokens(t.as_py(), ids) for t in batch.column(batch.num_columns - 1)]
                learn()
                lens = np.fromiter(map(len, rows), np.int64, len(rows))
                token = np.concatenate(rows)
                before = np.zeros_like(token)
                before[1:] = token[:-1]
                begin = np.cumsum(lens) - lens
                before[begin] = 0
                pair, which = np.unique(before * len(ids) + token, return_inverse=True)
                c, w = pair // len(ids), pair % len(ids)
                count, h = word["count"].view, hashes.view
                own = np.zeros(len(pair))
                keyed, lo, hi = word["key"].view[c], word["lo"].view[c], word["hi"].view[c]
                for s, at in _groups(deal(h[c])):
                    own[at] = _shard(path, s).bigrams(keyed[at], lo[at], hi[at], h[w[at]])
                uni = (count[w] + 1) / (n_all + v_all + 1)
                p = np.log10(own + word["rest"].view[c] * uni)[which]
                base = np.log10((count[token] + 1) / (n_all + v_all + 1))
                sums = lambda x: np.add.reduceat(x, begin)
                cols = [pa.array(lens), pa.array(sums((count[token] > 0).astype(np.int64))), pa.array(np.full(len(rows), n_all)), pa.array(sums(base)), pa.array(sums(p))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*(f.name for f in keep), *new])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return lean(df).select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, fields)


def _groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(key[part[0]]), part


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    A null id is in the fold of the empty text, and so never held out; null and empty texts are an end alone; repeated rows get a row each and
    teach as often; texts of any length are read whole; without training documents every token has probability 1.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = shared_dir(spark)
    model = train(docs.filter(fold("doc_id", 7) != 2), path)
    return score_texts(docs.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "text"), path, *model)

"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length code, control bytes apart from data bytes.

A data set is a folder with two Parquet tables. `ranks` (rank, id) says which id a rank stands for; frequent ids have
small ranks. `blocks` has one row per block of whole documents, in files whose names ascend with the documents: part and
seq (ascending in document order), start (ids
before the block), doc_ids and lens (little-endian int64, one per document), control (two bits per id: bytes it takes,
less one, four ids per byte) and data (the ranks' bytes, least significant first).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PLAIN, Pieces
from .common import Grown, Ids, lean, saved, shared_dir, slices, spread, table, tokenizer_path

#: Ids a block holds before it is closed; a document is never split.
BLOCK_IDS = 1 << 17

#: How the vocabulary with word ends cuts a lower-cased word.
PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")

LENGTHS = np.array([[((c >> (2 * j)) & 3) + 1 for j in range(4)] for c in range(256)], np.int64)
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2**32."""
    r = ranks.astype(np.int64)
    size = 1 + (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(size)
    at = ends - size
    data = np.zeros(int(ends[-1]) if len(r) else 0, np.uint8)
    data[at] = r & 0xFF
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        data[at[more] + k] = (r[more] >> (8 * k)) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers; lengths and places of four at a time come from tables by control byte."""
    c = np.frombuffer(control, np.uint8)
    group = np.cumsum(TOTALS[c]) - TOTALS[c]
    at = (group[:, None] + STARTS[c]).reshape(-1)[:n]
    size = LENGTHS[c].reshape(-1)[:n]
    d = np.frombuffer(data, np.uint8)
    out = d[at].astype(np.int64)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= d[at[more] + k].astype(np.int64) << (8 * k)
    return out


class WordEncoder:
    """Ids of whole texts under a vocabulary that drops white space; keeps the ids of each distinct word it has met."""

    def __init__(self, path: str):
        self.pieces = Pieces.of(path)
        self._empty()

    def _empty(self) -> None:
        self.words, self.lens, self.starts, self.flat = Ids(), Grown(np.int64), Grown(np.int64), Grown(np.uint16 if self.pieces.fast.base < 65_536 else np.uint32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if self.words.full:
            self._empty()
        rows, sizes = [], []
        for text in texts:
            raw = text.encode("utf-8") if text else b""
            rows.append(self.words.of((raw if b"<|" in raw else raw.lower()).split()))
            sizes.append(len(rows[-1]))
        self._learn()
        ids = np.concatenate(rows) if rows else np.empty(0, np.int64)
        lens = self.lens.view[ids]
        flat = self.flat.view[spread(self.starts.view[ids], lens)]
        sums = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(sizes)
        return flat, sums[ends] - sums[ends - np.array(sizes, np.int64)]

    def _learn(self) -> None:
        new = list(islice(self.words, self.lens.n, None))
        if not new:
            return
        counts, own, plain = np.zeros(len(new), np.int64), {}, []
        fast = np.ones(len(new), bool)
        for at in range(0, len(new), 256):  # blocks are looked at as a whole; few hold an odd word
            block = new[at : at + 256]
            text = b"\n".join(block).decode("utf-8")
            if "<|" not in text and (text.isascii() or PLAIN.fullmatch(text)):
                plain.append(text)
                continue
            for k, raw in enumerate(block, at):
                word = raw.decode("utf-8")
                if b"<|" in raw or not (raw.isascii() or PLAIN.fullmatch(word)):
                    own[k] = self.pieces.library.encode(word, add_special_tokens=False).ids
                    counts[k], fast[k] = len(own[k]), False
                else:
                    plain.append(word)
        pieces = PRE.findall("\n".join([*plain, ""]).lower()) if plain else []
        is_end = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
        cut = np.diff(np.flatnonzero(is_end), prepend=-1) - 1  # pieces of each word
        ids, n = self.pieces.ids([p.encode() for p in pieces if p != "\n"])
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(cut)
        counts[fast] = sums[ends] - sums[ends - cut]
        out = np.empty(int(counts.sum()), self.flat.data.dtype)
        at = np.cumsum(counts) - counts
        out[spread(at[fast], counts[fast])] = ids
        for k, x in own.items():
            out[at[k] : at[k] + len(x)] = x
        self.starts.extend(at + self.flat.n)
        self.lens.extend(counts)
        self.flat.extend(out)


def write_token_files(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1) -> str:
    """Encodes every text, adds the end id, and writes the data set described above in ascending doc_id order.

    Null and empty texts hold the end id alone; a null doc_id comes first and is written as the least int64; equal ids
    follow each other in the order of a hash of their texts. The texts are dealt once by ranges of (doc_id, hash), so a
    hot id doesn't meet in one task. Ids are kept as two bytes in the shared folder between the passes. The driver gets a
    row per vocabulary id (bounded by the vocabulary) and one per part.
    """
    vocabulary = vocabulary or tokenizer_path("word_bpe_49k.json")
    spark = df.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, before = WordEncoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, n = encoder.encode(batch.column("text").to_pylist())
                ids = np.empty(len(flat) + len(n), flat.dtype)
                at = np.cumsum(n + 1) - n - 1
                ids[spread(at, n)] = flat
                ids[at + n] = end_id
                raw, width = ids.tobytes(), ids.dtype.itemsize
                rows = [raw[int(a) * width : int(a + k + 1) * width] for a, k in zip(at, n)]
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, part, np.int32)), pa.array(np.arange(seq, seq + m)), batch.column("doc_id"), pa.array(before + at), pa.array(n + 1), pa.array(rows, pa.binary())],
                    names=["part", "seq", "doc_id", "before", "n", "ids"],
                )
                seq, before = seq + m, before + len(ids)

    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = lean(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    raw = saved(docs.mapInArrow(encode, "part int, seq long, doc_id long, before long, n long, ids binary"))
    parts = {r["part"]: r["n"] for r in raw.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(parts):
        first[p], total = total, total + parts[p]
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1)
    dtype = np.uint16 if size < 65_536 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                x = np.frombuffer(ids.as_buffer(), dtype)
                if len(x) < 4096:
                    np.add.at(seen, x, 1)
                else:
                    seen += np.bincount(x, minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["id", "n"])

    counted = raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = [r["id"] for r in sorted(counted, key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame([(k, i) for k, i in enumerate(order)] or [(0, end_id)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(size, np.int64)
    rank[order] = np.arange(len(order))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, seq, ids = batch.column("part").to_numpy(), batch.column("seq").to_numpy(), batch.column("ids")
            doc, before, n = pc.fill_null(batch.column("doc_id"), -(2**63)).to_numpy(), batch.column("before").to_numpy(), batch.column("n").to_numpy()
            at = 0
            while at < len(n):
                end, held = at + 1, n[at]
                while end < len(n) and part[end] == part[at] and seq[end] == seq[end - 1] + 1 and held + n[end] <= BLOCK_IDS:
                    held += n[end]
                    end += 1
                all_ids = np.concatenate([np.frombuffer(ids[k].as_buffer(), dtype) for k in range(at, end)])
                control, data = pack(rank[all_ids])
                yield pa.RecordBatch.from_pylist(
                    [{"part": int(part[at]), "seq": int(seq[at]), "start": first[int(part[at])] + int(before[at]), "doc_ids": doc[at:end].astype("<i8").tobytes(), "lens": n[at:end].astype("<i8").tobytes(), "control": control, "data": data}],
                    schema=schema,
                )
                at = end

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "lens", "control", "data"))])
    # a file for each part, in the parts' order: `raw` comes back in an order that its files' sizes give
    placed = raw.mapInArrow(blocks, BLOCKS).repartitionById(max(parts, default=0) + 1, F.col("part")).sortWithinPartitions("seq")
    placed.write.option("compression", "none").parquet(f"{path}/blocks")
    return path


BLOCKS = "part int, seq long, start long, doc_ids binary, lens binary, control binary, data binary"


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document of a data set: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    ids_of = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = {c: batch.column(c)[k].as_py() for c in ("start", "doc_ids", "lens", "control", "data")}
                doc, lens = np.frombuffer(got["doc_ids"], "<i8"), np.frombuffer(got["lens"], "<i8")
                ids = ids_of[unpack(got["control"], got["data"], int(lens.sum()))].astype("<u4")
                at = np.cumsum(lens) - lens
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * int(a) : 4 * int(a + n)]) for a, n in zip(at, lens)]
                cols = [pa.array(doc, mask=doc == -(2**63)), pa.array(got["start"] + at), pa.array(lens), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[int(a) : int(a + n)].tolist() for a, n in zip(at, lens)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("start", "doc_ids", "lens", "control", "data").mapInArrow(read, fields)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written and read back.

    Null and empty texts hold the end id alone, a null doc_id comes first, repeated rows get a place each, texts of any
    length are encoded whole, and no documents give no rows.
    """
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), shared_dir(spark)))

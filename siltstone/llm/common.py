"""What the operators of this package share: tables, folders all executors see, word ids."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import saved, shared_dir

__all__ = ["saved", "shared_dir"]

#: Bytes that a task's table of distinct words may take before it is emptied; results don't depend on it.
TABLE_BYTES = 96 << 20
#: Bytes of text that a worker handles at a time, but for one longer row.
SLICE_BYTES = 2 << 20
#: Bytes of rows that go to a worker as one batch.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table, or all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def fold(column: str, divisor: int):
    """crc32 of the id as text, modulo the divisor; a null id is read as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def slices(batch: pa.RecordBatch, column: int | str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together stay below `size` bytes, but for a row that is larger by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def lean(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends Python at most ARROW_BYTES at a time, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        df.sparkSession.conf.set(key, str(ARROW_BYTES))
    return df


def with_row_key(df: DataFrame, file: str = "__file", row: str = "__row") -> DataFrame:
    """The rows with two longs that tell each from all others and stay the same however often the rows are read.

    Rows of files are told by the hash of the file's name and their place in it; other rows are numbered and written to
    the shared folder first.
    """
    try:
        keyed = df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
        keyed.schema  # analysed here
        return keyed
    except AnalysisException:
        return saved(df.withColumn(file, F.lit(0).cast("long")).withColumn(row, F.monotonically_increasing_id()))


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and \\t..\\r, with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Ids(dict):
    """Numbers the distinct keys it is asked for, in order of first sight; knows about how many bytes it takes."""

    bytes = 0
    #: What an entry takes besides its key's characters: key and number as objects, and a place in the table.
    ENTRY = 180

    def __missing__(self, key):
        self[key] = n = len(self)
        self.bytes += self.ENTRY + len(key)
        return n

    @property
    def full(self) -> bool:
        return self.bytes > TABLE_BYTES

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype, width: int | None = None):
        self.data, self.n = np.empty((1024,) if width is None else (1024, width), dtype), 0

    def extend(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.data):
            new = np.empty((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            new[: self.n] = self.data[: self.n]
            self.data = new
        self.data[self.n : need] = rows
        self.n = need

    @property
    def view(self) -> np.ndarray:
        return self.data[: self.n]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... (lens[i] of them), one run after another."""
    total = int(lens.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    keep = lens > 0
    starts, lens = starts[keep].astype(np.int64), lens[keep].astype(np.int64)
    ends = np.cumsum(lens)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lens[:-1] - 1)
    return np.cumsum(out)


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; import here, for workers have the package as the driver does."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

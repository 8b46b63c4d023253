"""Token counts: pieces are counted once per distinct pre-token and summed by per-document frequencies.

The distinct pre-tokens are those of a task's recent texts, in a table of bounded size: to share one table between tasks
would mean to shuffle every pre-token of every document, which costs more than the merges it saves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PLAIN, Pieces
from .common import Grown, Ids, lean, slices, table, tokenizer_path

#: How byte-level vocabularies of this family cut a text before they merge.
PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Counter:
    """Token counts of texts; keeps the piece count of each distinct pre-token it has met."""

    def __init__(self, path: str):
        self.pieces = Pieces.of(path)
        self.cut = self.pieces.library.pre_tokenizer
        specials = [t.content for t in self.pieces.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.ids, self.counts = Ids(), Grown(np.int32)

    def _pieces(self, text: str) -> list[str]:
        """The text's pre-tokens: by PRE where that is sure to agree with the library, else as the library itself cuts."""
        return PRE.findall(text) if PLAIN.fullmatch(text) else [text[a:b] for _, (a, b) in self.cut.pre_tokenize_str(text)]

    def count(self, texts: list[str | None]) -> np.ndarray:
        if self.ids.full:
            self.ids, self.counts = Ids(), Grown(np.int32)
        out = np.zeros(len(texts), np.int64)
        seen, rows = [], []
        for k, text in enumerate(texts):
            parts = self.special.split(text) if text and self.special else [text]
            out[k] = len(parts) - 1  # special strings, a token each
            for part in parts:
                if part:
                    seen.append(np.unique(self.ids.of(self._pieces(part)), return_counts=True))  # this text's frequencies
                    rows.append(k)
            if len(self.ids) - self.counts.n > 50_000:
                self._learn()
        self._learn()
        counts = self.counts.view
        for k, (ids, freq) in zip(rows, seen):
            out[k] += int((counts[ids] * freq).sum())
        return out

    def _learn(self) -> None:
        """The token counts of pre-tokens that are new; ids are given in order of insertion."""
        new = [p.encode() for p in islice(self.ids, self.counts.n, None)]
        if new:
            self.counts.extend(self.pieces.counts(new).astype(np.int32))


def token_counts(
    df: DataFrame, text: str = "text", vocabulary: str | None = None, limit: int = 512, out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")
) -> DataFrame:
    """Adds to each row the UTF-8 bytes of a text, its tokens, and whether these exceed the limit.

    The join of pre-token counts with per-document frequencies is local to each task: nothing is shuffled, and a
    task's table is emptied beyond TABLE_BYTES. Nulls and empty texts have 0 bytes and 0 tokens. Special strings are a
    token each and are cut out first; texts with characters on which regex libraries may differ are cut into pre-tokens by
    the tokenizers library. Repeated rows are counted each. Columns of the input named as an output are replaced.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    keep = [f for f in df.schema.fields if f.name not in out and f.name != text]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for big in batches:
            for batch in slices(big, "__text"):
                col = batch.column(batch.schema.get_field_index("__text"))
                texts = col.to_pylist()
                size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
                n = counter.count(texts)
                cols = [batch.column(i) for i in range(len(names))]
                if text_kept:
                    cols.append(col)
                yield pa.RecordBatch.from_arrays([*cols, size, pa.array(n), pa.array(n > limit)], names=order)

    text_kept = text not in out
    order = [*names, *([text] if text_kept else []), *out]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ([f"`{text}` string"] if text_kept else []) + [f"`{out[0]}` long", f"`{out[1]}` long", f"`{out[2]}` boolean"])
    return lean(df).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, fields)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; null and empty texts have 0 of both, repeated rows and
    null ids a row each, long texts are counted whole, and no documents give no rows."""
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")

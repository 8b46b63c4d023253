"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans of each language."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import small
from .common import Grown, Ids, fold, lean, saved, slices, table

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BITS = 17
#: First code points of ranges, each with its script.
RANGES = [
    (0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x750, "Arabic"),
    (0x780, "Thaana"), (0x8A0, "Arabic"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"),
    (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
EDGES = np.array([a for a, _ in RANGES])
SCRIPTS = sorted({s for _, s in RANGES})
SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in RANGES])
KANA = SCRIPTS.index("Kana")


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' letter trigrams (an edge counts as a letter), how many each word has, and its script."""
    raw = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    c = raw.astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    inside = np.ones(len(raw), bool)
    ends = np.cumsum(n + 2)
    inside[ends - 1] = inside[ends - 2] = False
    script = SCRIPT_OF[np.searchsorted(EDGES, raw[ends - n - 1], "right") - 1]
    return h[inside[: len(h)]].astype(np.int64), n, script


class Model:
    """Scores of words by language; made from texts and their languages."""

    def __init__(self, texts: list[str], langs: list[str], smoothing: float = 0.05):
        self.langs = sorted(set(langs)) or ["und"]
        k = len(self.langs)
        counts = np.zeros((1 << BITS, k), np.float64)
        letters = np.zeros((len(SCRIPTS), k))
        for j, lang in enumerate(self.langs):
            freq: dict[str, int] = {}
            for text, own in zip(texts, langs):
                if own == lang:
                    for w in WORD.findall(text.lower()):
                        freq[w] = freq.get(w, 0) + 1
            if not freq:
                continue
            h, n, script = _grams(list(freq))
            weight = np.fromiter(freq.values(), np.float64, len(freq))
            counts[:, j] = np.bincount(h, np.repeat(weight, n), minlength=1 << BITS)
            letters[:, j] = np.bincount(script, weight * n, minlength=len(SCRIPTS))
        used = max(1, int((counts.sum(1) > 0).sum()))
        self.table = np.log((counts + smoothing) / (counts.sum(0) + smoothing * used)).astype(np.float32)
        self.table[counts.sum(1) == 0] = 0  # a trigram no language has says nothing
        share = letters / np.maximum(1, letters.sum(0))
        self.open = share >= 0.002
        self.open[~self.open.any(1)] = True  # a script no language has leaves all of them

    def scores(self, words: list[str]) -> np.ndarray:
        h, n, script = _grams(words)
        sums = np.add.reduceat(self.table[h], np.cumsum(n) - n, axis=0)
        sums -= sums.max(1, keepdims=True)
        sums = np.maximum(sums, -12)  # one odd word cannot outvote a sentence
        return np.where(self.open[script], sums, np.float32(-40)).astype(np.float32)


def viterbi(scores: np.ndarray, lens: np.ndarray, penalty: float) -> np.ndarray:
    """For texts of lens words, the best label of each word, where each change of label costs the penalty.

    Texts advance together, a word of each at a time; the first label wins a tie.
    """
    k = scores.shape[1]
    order = np.argsort(-lens, kind="stable")
    starts = (np.cumsum(lens) - lens)[order]
    n = lens[order]
    longest = int(n[0]) if len(n) else 0
    active = len(n) - np.searchsorted(np.sort(lens), np.arange(longest), "right")
    back = np.empty(scores.shape, np.int8 if k < 128 else np.int16)
    own = np.arange(k)
    delta = np.zeros((len(n), k), np.float32)
    for t in range(longest):
        m = active[t]
        at = starts[:m] + t
        d = delta[:m]
        if t:
            best = d.argmax(1)
            jump = d[np.arange(m), best] - np.float32(penalty)
            stay = d >= jump[:, None]
            back[at] = np.where(stay, own, best[:, None])
            np.maximum(d, jump[:, None], out=d)
        d += scores[at]
    state = delta.argmax(1)
    out = np.empty(len(scores), np.int64)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        out[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return out


class Labeller:
    """Labels texts; keeps the scores of each distinct word it has met."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self._empty()

    def _empty(self) -> None:
        self.ids, self.table, self.letters = Ids(), Grown(np.float32, len(self.model.langs)), Grown(np.int32)

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, all words' labels, and all words' letters."""
        if self.ids.full:
            self._empty()
        rows = [self.ids.of(WORD.findall(t.lower())) if t else np.empty(0, np.int64) for t in texts]
        new = list(islice(self.ids, self.letters.n, None))
        if new:
            self.table.extend(self.model.scores(new))
            self.letters.extend(np.fromiter(map(len, new), np.int32, len(new)))
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.concatenate(rows) if rows else np.empty(0, np.int64)
        return lens, viterbi(self.table.view[ids], lens, self.penalty), self.letters.view[ids]


def train(df: DataFrame, text: str, lang: str, key: str, per_language: int, most: int = 20_000) -> Model:
    """Fits a model on at most per_language labelled texts of each language, and `most` of all, those with the least hash of their key.

    Languages are counted first, so only the hashes that are small enough are ranked. Null languages, texts and keys
    teach nothing; a key that comes several times counts as often. The driver gets the sample's texts and nothing else.
    """
    labelled = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(lang).cast("string").alias("__lang"), F.col(text).cast("string").alias("__text"))
    counts = saved(labelled.groupBy("__lang").agg(F.count("*").alias("__n")))
    per_language = max(1, min(per_language, most // max(1, counts.count())))
    share = F.pmod(F.xxhash64("__key", "__lang"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = labelled.join(small(counts), "__lang").withColumn("__h", share).filter(F.col("__h") < 1.2 * per_language / F.col("__n"))
    w = Window.partitionBy("__lang").orderBy("__h", "__key")  # some 1.2 * per_language rows
    rows = chosen.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_language).orderBy("__lang", "__h", "__key").select("__lang", "__text").toArrow()
    return Model(rows.column("__text").to_pylist(), rows.column("__lang").to_pylist())


def detect_languages(df: DataFrame, model: Model, text: str = "text", penalty: float = 8.0, with_spans: bool = False) -> DataFrame:
    """Adds lang_pred, score, n_languages and, if asked for, spans to each row.

    A text's language is the one that labels most of its letters (the first in order, if tied) and the score is its share
    of them; texts that are null or have no letter are `und` with score 0. n_languages counts the labels in use. A span
    is (from, to, lang): code points of the text, the end left out. Columns of these names are replaced.
    """
    new = ["lang_pred", "score", "n_languages", *(["spans"] if with_spans else [])]
    keep = [f for f in df.schema.fields if f.name not in new]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labeller, k = Labeller(model, penalty), len(model.langs)
        names = np.array([*model.langs, "und"], object)
        for big in batches:
            for batch in slices(big, big.num_columns - 1):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                lens, labels, letters = labeller.label(texts)
                row = np.repeat(np.arange(len(texts)), lens)
                share = np.bincount(row * k + labels, letters, minlength=len(texts) * k).reshape(-1, k) if k else np.zeros((len(texts), 1))
                total, best = share.sum(1), share.argmax(1)
                score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
                cols = [pa.array(names[np.where(total > 0, best, k)], pa.string()), pa.array(score), pa.array((share > 0).sum(1).astype(np.int32))]
                if with_spans:
                    cols.append(pa.array(_spans(texts, lens, labels, model.langs), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*(f.name for f in keep), *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["lang_pred string", "score double", "n_languages int", "spans array<struct<`from`:int,`to`:int,lang:string>>"][: 3 + with_spans]
    return lean(df).select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, ", ".join(fields))


def _spans(texts: list[str | None], lens: np.ndarray, labels: np.ndarray, langs: list[str]) -> list[list[dict]]:
    out, at = [], 0
    for text, n in zip(texts, lens):
        own: list[dict] = []
        # lower-casing may change lengths, so places come from the text as it is when both have the same words
        places = [m.span() for m in WORD.finditer(text)] if text else []
        for (a, b), label in zip(places, labels[at : at + n]):
            if own and own[-1]["lang"] == langs[label]:
                own[-1]["to"] = b
            else:
                own.append({"from": a, "to": b, "lang": langs[label]})
        at += int(n)
        out.append(own)
    return out


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_languages of every document.

    A null id is in the fold of the empty text; null texts and texts without letters are `und` with score 0; ties go to the
    first language in order; repeated rows get a row each; texts of any length are read whole; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.filter(fold("doc_id", 4) != 2), "text", "lang", "doc_id", per_language=1000)
    found = detect_languages(docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text"), model)
    return found.drop("text")

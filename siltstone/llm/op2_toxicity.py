"""Toxicity: a support vector machine on sentences, over a subsequence string kernel with Nystroem landmarks.

The kernel of two words (Lodhi et al. 2002) counts the subsequences of three letters that they share, each discounted by
the stretch it spans, so a word with gaps or inserted characters stays close to the word it hides. It is normalised and
raised to a power, which leaves a kernel. The kernel of two sentences is the sum over the pairs of their distinct words (a
convolution kernel); landmarks are sentences of one word, so a sentence's features are sums over its words, and so is its margin.

Sentences inherit the label of their document. As in multiple-instance learning, the machine is fitted again with those
sentences of toxic documents that it finds toxic (or the most toxic one, if it finds none). A document's score follows from
its most toxic sentence and the number of its sentences.
"""

from __future__ import annotations

import pickle
import random
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Grown, Ids, fold, lean, slices, table

DECAY, POWER = 0.6, 3
#: Letters of a subsequence lie within so many places of each other.
SPAN = 7
#: A word counts for nothing if a bound of its similarity to all toxic landmarks is below this.
NEAR = 0.5
LONGEST, STEP = 20, 10  # characters of a piece of a long word, and how far the next one starts
#: How much more those count that start with a word's beginning.
FRONT = 2.0
#: Words of a sentence that no full stop ends.
WORDS = 24
#: Digits and signs that are read as the letters they look like.
ALIKE = dict(zip("013457@$!|", "oieastasil"))
OTHERS = 11
BEGIN, END = 27, 28
KINDS = 29 + OTHERS
CUBE = KINDS**3


def _codes() -> np.ndarray:
    """A number for each character: a-z by themselves, few numbers for all other letters, 0 for the rest (a gap)."""
    out = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        if unicodedata.category(chr(cp))[0] == "L":
            c = chr(cp).lower()[:1]
            out[cp] = ord(c) - 96 if "a" <= c <= "z" else 29 + ord(c) % OTHERS
    for c, like in ALIKE.items():
        out[ord(c)] = ord(like) - 96
    return out


CODES = _codes()
LETTER = CODES.copy()
LETTER[[ord(c) for c in ALIKE]] = 0
#: The discount of a subsequence by how far its last letter is from its first.
WEIGHT = np.float64(DECAY) ** np.arange(1, SPAN + 1)


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' characters by number, with marks beside the first and the last letter, each word after a place of its own;
    where each word begins; and how many letters it has. What is outside the letters is left out."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(n) - n
    raw = np.frombuffer("".join(f"\0{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.where(raw < 0x10000, raw, 0)
    letter = LETTER[raw] > 0
    place = np.arange(len(raw))
    first = np.minimum.reduceat(np.where(letter, place, len(raw)), begin)
    last = np.maximum.reduceat(np.where(letter, place, -1), begin)
    letters = np.add.reduceat(letter.astype(np.int64), begin)
    code = CODES[raw]
    # a digit or sign stands for a letter only between letters
    code[(place < np.repeat(first, n)) | (place > np.repeat(last, n))] = 0
    some = letters > 0
    code[first[some] - 1], code[last[some] + 1] = BEGIN, END
    return code, begin, letters


def _occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of a subsequence: its word, its number and how far its last letter is from its first."""
    code, begin, _ = encode(words)
    of = np.zeros(len(code), np.int64)
    of[begin[1:]] = 1
    of = np.cumsum(of)
    c = np.concatenate([code, np.zeros(SPAN, np.uint8)]).astype(np.int64)
    w = np.concatenate([of, np.full(SPAN, -1)])
    head = np.flatnonzero(code)
    a, own = c[head] * (KINDS * KINDS), of[head]
    word, number, reach = [], [], []
    for d2 in range(2, SPAN):
        e = c[head + d2]
        far = np.flatnonzero((e > 0) & (w[head + d2] == own))
        at, start, end = head[far], a[far] + e[far], own[far]
        for d1 in range(1, d2):
            b = c[at + d1]
            ok = np.flatnonzero(b)
            word.append(end[ok])
            number.append(start[ok] + b[ok] * KINDS)
            reach.append(np.full(len(ok), d2, np.int8))
    return np.concatenate(word), np.concatenate(number), np.concatenate(reach)


def _value(number: np.ndarray, reach: np.ndarray) -> np.ndarray:
    return WEIGHT[reach] * np.where(number // (KINDS * KINDS) == BEGIN, FRONT, 1.0)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words: subsequences as (word, number, value), each once and in order of words, and the length of each word's vector."""
    word, number, reach = _occurrences(words)
    key = np.sort((word * CUBE + number) << 3 | reach)
    if not len(key):
        return key, key, np.empty(0, np.float32), np.zeros(len(words), np.float32)
    value = _value((key >> 3) % CUBE, key & 7)
    key >>= 3
    start = np.flatnonzero(np.diff(key, prepend=-1))
    value, key = np.add.reduceat(value, start), key[start]
    word = key // CUBE
    length = np.sqrt(np.bincount(word, value * value, minlength=len(words)))
    return word, key - word * CUBE, value.astype(np.float32), length.astype(np.float32)


class Kernel:
    """Values of the kernel between words and a fixed list of landmarks, of which the first `toxic` are toxic: 0 to 1."""

    def __init__(self, landmarks: list[str], toxic: int | None = None):
        self.landmarks = landmarks
        word, number, value, length = features(landmarks)
        used, place = np.unique(number, return_inverse=True)
        self.row = np.full(CUBE, -1, np.int32)  # of the subsequences that a landmark has
        self.row[used] = np.arange(len(used))
        self.table = np.zeros((len(used), len(landmarks)), np.float32)
        self.table[place, word] = value / np.maximum(length[word], 1e-9)
        self.most = np.zeros(CUBE, np.float32)  # what a subsequence is worth to a toxic landmark at most
        self.most[used] = self.table[:, :toxic].max(1) if len(used) else 0

    def plain(self, words: list[str]) -> np.ndarray:
        """The normalised string kernel, before it is raised to the power."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for at in range(0, len(words), 2048):
            word, number, value, length = features(words[at : at + 2048])
            row = self.row[number]
            some = np.flatnonzero(row >= 0)
            if not len(some):
                continue
            word, part = word[some], self.table[row[some]]
            part *= (value[some] / length[word])[:, None]
            start = np.flatnonzero(np.diff(word, prepend=-1))
            out[at + word[start]] = np.add.reduceat(part, start, axis=0)
        return out

    def near(self, words: list[str]) -> np.ndarray:
        """Which words may be near to a toxic landmark: the best of all landmarks is taken for each subsequence, and the
        vector's length without what equal subsequences add to it, so no similarity exceeds the quotient."""
        out = np.zeros(len(words), bool)
        for at in range(0, len(words), 8192):
            n = len(words[at : at + 8192])
            word, number, reach = _occurrences(words[at : at + 8192])
            value = _value(number, reach)
            most = np.bincount(word, value * self.most[number], minlength=n)
            out[at : at + n] = most >= NEAR * np.maximum(np.sqrt(np.bincount(word, value * value, minlength=n)), 1e-9)
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        some = np.flatnonzero(self.near(words))
        out[some] = np.minimum(self.plain([words[k] for k in some]), 1.0) ** POWER
        return out


class Vocabulary:
    """Distinct words by number, each with its values; filled as texts are read, emptied when it grows large."""

    def __init__(self, value, width: int):
        self.value, self.width = value, width
        self._empty()

    def _empty(self) -> None:
        self.ids, self.ends, self.alone = Ids(), Grown(bool), Grown(bool)
        self.slot, self.values = Grown(np.int32), Grown(np.float32, self.width)  # most words are worth nothing: slot 0
        self.values.extend(np.zeros((1, self.width), np.float32))

    def _of(self, words: list[str]) -> np.ndarray:
        """Values of words; a long one has the largest of its overlapping pieces."""
        out = np.zeros((len(words), self.width), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        short, long = np.flatnonzero(size <= LONGEST), np.flatnonzero(size > LONGEST)
        if len(short):
            out[short] = self.value([words[k] for k in short] if len(long) else words).reshape(-1, self.width)
        if len(long):
            pieces = Ids()
            which = [pieces[words[k][at : at + LONGEST]] for k in long for at in range(0, size[k] - LONGEST + STEP, STEP)]
            start = np.cumsum(-(-(size[long] - LONGEST + STEP) // STEP))
            got = self.value(list(pieces)).reshape(-1, self.width)[which]
            out[long] = np.maximum.reduceat(got, np.concatenate([[0], start[:-1]]), axis=0)
        return out

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all sentences: the sums of their distinct words' values, the number of their text, and how many sentences each text has.

        A sentence ends with a word that ends with . ! or ?, or after WORDS words. Single letters with white space between
        them count as a word, too, in the sentence of the first of them.
        """
        if self.ids.full or self.values.n * self.width > 4_000_000:
            self._empty()
        raw = [t.encode("utf-8", "replace").lower().split() if t else [] for t in texts]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = np.concatenate([np.empty(0, np.int64), *map(self.ids.of, raw)])
        if not len(ids):
            return np.zeros((0, self.width), np.float32), ids, np.zeros(len(texts), np.int64)
        for at in range(self.ends.n, len(self.ids), 50_000):
            new = list(islice(self.ids, at, at + 50_000))
            self.ends.extend(np.fromiter((w[-1] in b".!?" for w in new), bool, len(new)))
            new = [w.decode("utf-8", "replace") for w in new]
            letters = encode(new)[2]
            self.alone.extend(letters == 1)
            slot = np.zeros(len(new), np.int32)
            some = np.flatnonzero(letters >= 3)
            if len(some):
                values = self._of([new[k] for k in some])
                worth = np.flatnonzero((values != 0).any(1))
                slot[some[worth]] = self.values.n + np.arange(len(worth))
                self.values.extend(values[worth])
            self.slot.extend(slot)
        place, first = np.arange(len(ids)), np.zeros(len(ids), bool)
        text_start = (np.cumsum(lens) - lens)[lens > 0]
        first[text_start] = True
        first[1:] |= self.ends.view[ids][:-1]
        first |= (place - np.maximum.accumulate(np.where(first, place, 0))) % WORDS == 0
        start = np.flatnonzero(first)
        sums = np.zeros((len(start), self.width), np.float32)
        slot = self.slot.view[ids]
        worth = np.flatnonzero(slot)
        if len(worth):
            key = np.sort((np.cumsum(first)[worth] - 1) * self.values.n + slot[worth])
            key = key[np.diff(key, prepend=-1) > 0]
            own, word = key // self.values.n, key % self.values.n
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[begin]] = np.add.reduceat(self.values.view[word], begin, axis=0)
        text = np.repeat(np.arange(len(texts)), lens)
        alone = self.alone.view[ids]
        new_run = alone & np.concatenate([[True], ~alone[:-1] | (text[1:] != text[:-1])])
        run = np.flatnonzero(new_run)
        if len(run):
            size = np.bincount(np.cumsum(new_run)[alone] - 1)
            keep = size >= 3
            run, size = run[keep], size[keep]
            if len(run):
                flat = [w for r in raw for w in r]
                letter = lambda w: next((c for c in w.decode("utf-8", "replace") if c < "\U00010000" and LETTER[ord(c)]), "")
                spelled = ["".join(map(letter, flat[a : a + n])) for a, n in zip(run, size)]
                at, some = np.searchsorted(start, run, "right") - 1, [k for k, w in enumerate(spelled) if len(w) >= 3]
                if some:
                    np.add.at(sums, at[some], self._of([spelled[k] for k in some]))
        return sums, text[start], np.bincount(text[start], minlength=len(texts))


PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Model:
    """Margins of sentences, and scores of documents from them."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, bias: float):
        self.kernel, self.weights, self.bias = kernel, weights, bias
        self.curve = np.array([1.0, 0.0, 0.0, -6.0])

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds to the margin of its sentence."""
        return (self.kernel(words) @ self.weights).astype(np.float32)

    def score(self, most: np.ndarray, above: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of documents, from the margin of their most toxic sentence, the sum of positive margins, and how many sentences they have."""
        return 1 / (1 + np.exp(-np.clip(self._signs(most, above, count) @ self.curve, -30, 30)))

    @staticmethod
    def _signs(most: np.ndarray, above: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.c_[np.clip(most, -2, 3), np.log1p(4 * above), -np.log1p(count), np.ones(len(most))]

    def calibrate(self, most: np.ndarray, above: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> None:
        """A logistic curve; margins are of documents not trained on. Larger margins always speak for toxicity, more sentences never do."""
        x, y = self._signs(most, above, count), np.where(toxic > 0, 1.0, -1.0)
        used = [0, 1, 2, 3]
        beta = _logistic(x, y)
        while (beta[:-1] < 0).any():
            used = [u for u, v in zip(used, beta) if v >= 0 or u == 3]
            beta = _logistic(x[:, used], y)
        self.curve = np.zeros(4)
        self.curve[used] = beta
        # where both labels are as likely, the score is 0.7
        self.curve[3] += np.log(0.7 / 0.3)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    ridge = np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    loss = lambda b: np.logaddexp(0, -y * (x @ b)).sum() + (ridge * b * b).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - (y > 0)) + ridge * beta)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-7:
            break
    return beta


class Scorer:
    """Scores texts; keeps what each distinct word it has met adds to a margin."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, Vocabulary(model.words, 1)

    def signs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, the largest margin of its sentences (the bias, if it has none), the sum of positive ones, and how many it has."""
        sums, text, count = self.vocabulary.sentences(texts)
        margin = sums[:, 0].astype(float) + self.model.bias
        most = np.full(len(texts), -np.inf)
        np.maximum.at(most, text, margin)
        return np.where(count > 0, most, self.model.bias), np.bincount(text, np.maximum(margin, 0), minlength=len(texts)), count

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.model.score(*self.signs(texts))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, block: int = 20_000) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps over blocks of rows."""
    n = x.shape[1] + 1
    w, reg = np.zeros(n), np.eye(n)
    reg[-1, -1] = 1e-6
    for _ in range(40):
        g, h = reg @ w, reg.copy()
        for at in range(0, len(x), block):
            a = np.hstack([x[at : at + block].astype(float), np.ones((len(x[at : at + block]), 1))])
            own, cost = y[at : at + block], weight[at : at + block]
            on = own * (a @ w) < 1
            a, own, cost = a[on], own[on], cost[on]
            g -= a.T @ (cost * (own - a @ w))
            h += (a.T * cost) @ a
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def disguised(word: str, rng: random.Random) -> str:
    """The word with a character put in between its letters, or one doubled."""
    k = rng.randrange(1, len(word)) if len(word) > 1 else 0
    return word[:k] + rng.choice([rng.choice("abcdefghijklmnopqrstuvwxyz"), rng.choice("-._*"), word[k]]) + word[k:]


def _disguised_text(text: str, rng: random.Random) -> str:
    return " ".join(disguised(w, rng) if len(w) >= 4 else w for w in text.split())


def fit(texts: list[str], toxic: list[int], landmarks: int = 96, seed: int = 7) -> Model:
    """Trains on texts and their labels; without toxic examples every score is near 0.

    The curve of scores comes from margins that machines of one half of the texts give to the other half.
    """
    label = np.array(toxic, float)
    model = _machine(texts, label, landmarks, seed)
    if model is None:
        return Model(Kernel(["aaa"]), np.zeros(1), -1.0)
    half = np.fromiter((crc32(t.encode("utf-8", "replace")) & 1 for t in texts), np.int64, len(texts))
    signs = np.zeros((3, len(texts)))
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
        scorer = Scorer(_machine([texts[k] for k in own], label[own], landmarks, seed) or model)
        for at in range(0, len(other), 200):
            some = other[at : at + 200]
            signs[:, some] = scorer.signs([texts[k] for k in some])
    model.calibrate(*signs, label)
    return model


def _gain(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The log likelihood ratio of a word's presence, from how many clean and toxic texts have it; 0 if clean ones have it as often."""
    share, both = n / total, n.sum(1) / total.sum()
    part = lambda k, p: k * np.log(np.maximum(p, 1e-12))
    gain = sum(part(n[:, k], share[:, k]) - part(n[:, k], both) + part(total[k] - n[:, k], 1 - share[:, k]) - part(total[k] - n[:, k], 1 - both) for k in (0, 1))
    return np.where(share[:, 1] > share[:, 0], gain, 0.0)


def _stems(word: str) -> list[str]:
    """The word, and its beginnings of at least three letters."""
    return [word[:n] for n in range(3, min(len(word), LONGEST) + 1)]


def _landmarks(texts: list[str], toxic: np.ndarray, most: int) -> tuple[list[str], list[str]]:
    """Words and beginnings of words that tell toxic texts from others, and the words of other texts.

    They are taken one by one, none close to an earlier one, and each for toxic texts that the earlier ones reach less,
    as long as chance is a bad explanation. A candidate counts as often as it has different neighbours, if that is less
    than in how many texts it is: so copies of one text count once.
    """
    bag = lambda t: {w for x in set(t.lower().split()) if len(w := x.strip(PUNCTUATION)) >= 3 and w.isalpha()}
    df: Counter = Counter()
    for text, y in zip(texts, toxic):
        if y > 0:
            df.update({s for w in bag(text) for s in _stems(w)})
    total = np.array([max(1, (toxic <= 0).sum()), max(1, (toxic > 0).sum())], float)
    least = max(2, 5e-3 * total[1])
    words = sorted(w for w, n in df.items() if n >= least)
    place, tried = {w: k for k, w in enumerate(words)}, max(2, len(df))
    clean: Counter = Counter()
    plain: set[str] = set()
    for text, y in zip(texts, toxic):
        if y <= 0:
            own = bag(text)
            plain |= own
            clean.update({k for w in own for s in _stems(w) if (k := place.get(s)) is not None})
    n = np.array([[clean[k], df[w]] for k, w in enumerate(words)], float).reshape(-1, 2)
    gain = _gain(n, total)
    order = [k for k in sorted(range(len(words)), key=lambda k: (-gain[k], -len(words[k]), words[k]))[:3000] if gain[k] > 0]
    if not order:
        return [], []
    words, n = [words[k] for k in order], n[order]
    place = {w: k for k, w in enumerate(words)}
    has = np.zeros((len(words), len(texts)), bool)
    contexts = np.zeros(len(words))
    met: set[tuple[int, int]] = set()
    for i, text in enumerate(texts):
        t = ["", *(w.strip(PUNCTUATION) for w in text.lower().split()), ""] if toxic[i] > 0 else ()
        for j, w in enumerate(t):
            for s in _stems(w) if len(w) >= 3 else ():
                if (k := place.get(s)) is not None:
                    has[k, i] = True
                    if contexts[k] < n[k, 1] and (key := (k, hash((t[j - 1], t[j + 1])))) not in met:
                        met.add(key)
                        contexts[k] += 1
    chosen: list[int] = []
    near = np.zeros(len(words), bool)
    worth = (toxic > 0).astype(float)  # of each text; less for each landmark that reaches it
    while len(chosen) < most:
        now = np.minimum(has @ worth, contexts)
        gain = np.where(near, 0, _gain(np.c_[n[:, 0], now], np.array([total[0], max(1.0, worth.sum())])))
        k = int(gain.argmax())  # the longest, if tied
        if gain[k] < (np.log(tried) + 1 if chosen else 0.1):
            break
        chosen.append(k)
        worth[has[k]] *= 0.7
        near |= Kernel([words[k]]).plain(words)[:, 0] > 0.85
    marks = [words[k] for k in chosen]
    rest = sorted(plain - set(marks))
    return marks, rest


def _machine(texts: list[str], toxic: np.ndarray, landmarks: int, seed: int) -> Model | None:
    """The machine over sentences; None if there are no toxic texts with words.

    Half of the landmarks are words of toxic texts, a quarter are words of other texts at random, and a quarter are those
    words of other texts that a first machine takes for the most toxic.
    """
    marks, rest = _landmarks(texts, toxic, landmarks // 2)
    if not marks:
        return None
    n = len(marks)
    marks += random.Random(seed).sample(rest, min(landmarks // 4, len(rest)))
    few = np.flatnonzero((toxic > 0) | (np.arange(len(texts)) % 3 == 0))
    first = _svm_over(marks, n, [texts[k] for k in few], toxic[few], seed)
    if first is None or not rest:
        return first
    worst = np.argsort(-first.words(rest), kind="stable")[: landmarks // 4]
    return _svm_over(list(dict.fromkeys([*marks, *(rest[k] for k in worst)])), n, texts, toxic, seed)


def _svm_over(marks: list[str], n: int, texts: list[str], toxic: np.ndarray, seed: int, rounds: int = 4) -> Model | None:
    kernel = Kernel(marks, n)
    value, vector = np.linalg.eigh((np.minimum(kernel.plain(marks), 1.0) ** POWER).astype(float))
    keep = value > 1e-3
    root = (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T  # Nystroem: of the landmarks' own kernel
    vocabulary, rng = Vocabulary(kernel, len(marks)), random.Random(seed)
    parts, of = [], []
    for disguise in (False, True):  # a disguise changes no label
        some = np.arange(len(texts)) if not disguise else np.flatnonzero((toxic > 0) | (np.arange(len(texts)) % 4 == 0))
        for at in range(0, len(some), 100):
            block = some[at : at + 100]
            sums, text, _ = vocabulary.sentences([_disguised_text(texts[k], rng) if disguise else texts[k] for k in block])
            near = np.flatnonzero((np.abs(sums).max(1) > 1e-3) | (toxic[block[text]] > 0)) if len(sums) else []
            parts.append((sums[near] @ root).astype(np.float32))
            of.append(block[text[near]])
    x, of = np.concatenate(parts), np.concatenate(of)
    del parts, vocabulary
    if not len(x):
        return None
    mark = np.round(x @ np.random.default_rng(seed).normal(size=x.shape[1]), 6)
    one = np.sort(np.unique(mark, return_index=True)[1])  # copies of a sentence count once
    x, of = x[one], of[one]
    bad = toxic[of] > 0
    if not bad.any():
        return None
    chosen, nothing = bad.copy(), np.zeros((1, x.shape[1]), np.float32)
    for _ in range(rounds):
        use = chosen | ~bad
        y = np.where(chosen[use], 1.0, -1.0)
        weight = np.where(y > 0, 2000 / max(1, (y > 0).sum()), 4500 / max(1, (y < 0).sum()))
        # the sentences that are near to no landmark, as one
        w, b = _svm(np.vstack([x[use], nothing]), np.r_[y, -1.0], np.r_[weight, 1500.0])
        margin = x @ w + b
        chosen = bad & (margin > 0)
        if not chosen.any():
            chosen = bad & (margin >= margin[bad].max())
    return Model(kernel, root @ w, b)


def train(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", most: int = 4000) -> Model:
    """Fits on at most `most` labelled documents, those with the least hash of their key; null labels and texts don't count.

    One task gets those documents' texts and fits; the driver gets the model and nothing else.
    """
    picked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t is not null").join(F.broadcast(picked), "k").select("k", "t", "y").repartition(1).sortWithinPartitions("k", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += [int(y > 0) for y in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, toxic))], pa.binary())], names=["model"])

    made = lean(rows.select("t", "y")).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], [])  # no task runs where Spark knows that there are no rows


def score_toxicity(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the columns `out` to each row: score (0 to 1) and predicted (1 if score >= threshold).

    Null, empty and wordless texts get the score of no sentence. Each row is scored by itself and as a whole, so ties and
    repeated rows agree. Input columns named like an output are replaced; all others are kept.
    """
    keep = [f for f in df.schema.fields if f.name not in out]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for big in batches:
            for batch in slices(big, big.num_columns - 1):
                score = scorer.score(batch.column(batch.num_columns - 1).to_pylist())
                cols = [*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in keep), *out])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out[0]}` double", f"`{out[1]}` int"])
    return lean(df).select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, fields)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null id is in the fold of the empty text, never null; null and empty texts get the score of no sentence, documents
    of any length are read whole, repeated rows get a row each, and no documents give no rows. Labels of unknown ids, and
    null labels, teach nothing; an id with several labels is toxic if one says so.
    """
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = train(docs, labels.filter(fold("doc_id", 3) != 1))
    return score_toxicity(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model).drop("text")

"""Byte-level BPE over many short pieces at once: each round merges, in every piece, the leftmost pair of lowest rank."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

from .common import spread

#: Longer pieces go to the tokenizers library, one at a time.
LONGEST = 48


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PieceBPE:
    """ids(pieces) for pieces that the vocabulary's pre-tokenizer leaves whole."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        codes = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank, self.made = codes[order], order.astype(np.int32), made[order]
        bits = 19
        self.shift = np.uint64(64 - bits)
        # open addressing, four slots in a row for each start
        self.slots = np.full((1 << bits) + 16, -1, np.int32)
        for k, h in enumerate(self._hash(self.codes).tolist()):
            while self.slots[h] >= 0:
                h += 1
            self.slots[h] = k
        self.none = np.int32(2**31 - 1)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair, or -1."""
        codes = a * self.base + b
        at = self._hash(codes)
        got = self.slots[at]
        out = np.where((got >= 0) & (self.codes[got] == codes), got, -1)
        todo = np.flatnonzero((got >= 0) & (out < 0))
        while len(todo):
            at[todo] += 1
            got = self.slots[at[todo]]
            hit = (got >= 0) & (self.codes[got] == codes[todo])
            out[todo[hit]] = got[hit]
            todo = todo[(got >= 0) & ~hit]
        return out

    def _merged(self, pieces: list[bytes], block: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of like length, a block at a time: which they are, and their ids with -1 where a token was merged away."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lens, kind="stable")
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else lens
        for at in range(0, len(order), block):
            some = order[at : at + block]
            n, width = lens[some], int(lens[some[-1]])
            ids = np.full((len(some), width + 1), -1, np.int64)
            r = np.repeat(np.arange(len(some)), n)
            c = spread(np.zeros(len(some), np.int64), n)
            ids[r, c] = self.inner[raw[spread(starts[some], n)]]
            ids[np.arange(len(some)), n - 1] = self.last[raw[starts[some] + n - 1]]
            self._merge(ids, n)
            yield some, ids

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many ids each piece has (none longer than LONGEST bytes, none empty); no list of ids is made."""
        out = np.empty(len(pieces), np.int64)
        for some, ids in self._merged(pieces):
            out[some] = (ids >= 0).sum(1)
        return out

    def short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none longer than LONGEST bytes, none empty), and how many each has."""
        counts, rows, order = np.empty(len(pieces), np.int64), [], []
        for some, ids in self._merged(pieces):
            alive = ids >= 0
            counts[some] = alive.sum(1)
            rows.append(ids[alive])
            order.append(some)
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        begin = np.empty(len(pieces), np.int64)
        done = counts[order]
        begin[order] = np.cumsum(done) - done
        return flat[spread(begin, counts)], counts

    def _merge(self, ids: np.ndarray, n: np.ndarray) -> None:
        """Merges in place; a token that was merged into its left neighbour becomes -1."""
        width = ids.shape[1]
        cols = np.arange(width)
        after = np.where(cols + 1 < n[:, None], cols + 1, -1)  # of each live position, the next live one
        before = np.broadcast_to(cols - 1, ids.shape).copy()
        merge = np.full(ids.shape, -1, np.int32)
        rank = np.full(ids.shape, self.none, np.int32)
        r, c = np.nonzero(after >= 0)
        got = self._look(ids[r, c], ids[r, c + 1])
        merge[r, c] = got
        rank[r, c] = np.where(got >= 0, self.rank[got], self.none)
        live = np.arange(len(ids))
        while len(live):
            part = rank[live]
            p = part.argmin(1)
            ok = part[np.arange(len(live)), p] < self.none
            live, p = live[ok], p[ok]
            if not len(live):
                return
            q = after[live, p]
            ids[live, p] = self.made[merge[live, p]]
            ids[live, q] = -1
            rank[live, q] = self.none
            nxt = after[live, q]
            after[live, p] = nxt
            has = nxt >= 0
            before[live[has], nxt[has]] = p[has]
            rank[live, p] = self.none
            self._again(ids, rank, merge, live[has], p[has], nxt[has])
            prev = before[live, p]
            has = prev >= 0
            self._again(ids, rank, merge, live[has], prev[has], p[has])

    def _again(self, ids, rank, merge, row, left, right) -> None:
        got = self._look(ids[row, left], ids[row, right])
        merge[row, left] = got
        rank[row, left] = np.where(got >= 0, self.rank[got], self.none)


#: Characters on which Python and the library agree about classes, case and normal form.
PLAIN = regex.compile("[\t-\r -~¡-¬®-ÿ–—‘’“”…€]*")


class Pieces:
    """Ids of distinct pre-tokens or words, by PieceBPE where that is sure, else by the library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.fast, self.library = PieceBPE(path), Tokenizer.from_file(path)

    @classmethod
    @lru_cache(maxsize=1)
    def of(cls, path: str) -> Pieces:
        """One for each worker: a vocabulary's tables don't grow, and reading them takes as long as a small task."""
        return cls(path)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many ids each piece has, for pieces the pre-tokenizer leaves whole."""
        out = np.empty(len(pieces), np.int64)
        plain = [k for k, p in enumerate(pieces) if len(p) <= LONGEST]
        out[plain] = self.fast.counts([pieces[k] for k in plain] if len(plain) < len(pieces) else pieces)
        for k, p in enumerate(pieces):
            if len(p) > LONGEST:
                out[k] = len(self.library.encode(p.decode("utf-8"), add_special_tokens=False))
        return out

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For pieces the pre-tokenizer leaves whole."""
        odd = [k for k, p in enumerate(pieces) if len(p) > LONGEST]
        if not odd:
            return self.fast.short(pieces)
        bad = set(odd)
        plain = [k for k in range(len(pieces)) if k not in bad]
        flat, n = self.fast.short([pieces[k] for k in plain])
        counts = np.zeros(len(pieces), np.int64)
        counts[plain] = n
        own = [self.library.encode(pieces[k].decode("utf-8"), add_special_tokens=False).ids for k in odd]
        counts[odd] = [len(x) for x in own]
        out = np.empty(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        out[spread(begin[plain], n)] = flat
        for k, x in zip(odd, own):
            out[begin[k] : begin[k] + len(x)] = x
        return out, counts

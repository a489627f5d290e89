"""Segmentation lattices over a fixed vocabulary of pieces.

A text is its words (runs of other than white space), each with the vocabulary's
word mark before it; no piece reaches over a word's end, so the sum over all
segmentations of a text is the product of the sums over its words, which may be of
any length. A character that is no piece is an edge of its own at the probability of
the unknown.

Words of like length go through the recursions together, as columns of arrays.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U64, _BASE, Table, Words, bounded, chunks, column, mixed, powers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Letters up to which words are put together by length exactly, and letters whose pieces are known at a time.
SHORT, SPAN = 32, 4096
UNKNOWN = -16.0
ZIPF = 50.0


def _poly(x: str) -> int:
    h, p, m = 0, 1, (1 << 64) - 1
    for c in x:
        h, p = (h + (ord(c) + 1) * p) & m, (p * int(_BASE)) & m
    return h


class Vocabulary:
    """The ordinary pieces of a sentencepiece model, and log probabilities from its scores."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids]
        pieces = [(p, s) for p, s in pieces if MARK not in p[1:] and s > -1e8]
        h = mixed(np.array([_poly(p) for p, _ in pieces], np.uint64))
        order = np.argsort(h)
        self.pieces = [pieces[i][0] for i in order]
        self.keys = h[order]
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.longest = int(self.size.max())
        # the scores of this kind of model are minus the rank of a merge: probabilities by Zipf's law of it
        rank = -np.array([pieces[i][1] for i in order])
        p = 1 / (rank - rank.min() + ZIPF)
        self.log_p = np.log(p / p.sum())

    def open(self) -> Vocabulary:
        if not hasattr(self, "table"):
            self.table = Table(self.keys)
        return self


@lru_cache(4)
def vocabulary_of(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a file, read once by each process."""
    return Vocabulary(path)


class Group:
    """Words side by side: the piece id of every substring that is one, by where it ends."""

    def __init__(self, vocabulary: Vocabulary, letters: np.ndarray):
        self.n, self.length = letters.shape[0], letters.shape[1]
        up, down = powers(self.length + 1)
        sums = np.zeros((self.length + 1, self.n), np.uint64)
        np.cumsum(((letters.astype(np.uint64) + U64(1)) * up[: self.length]).T, axis=0, out=sums[1:])
        by_end: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.length + 1)]
        for size in range(1, min(vocabulary.longest, self.length) + 1):
            h = (sums[size:] - sums[:-size]) * down[: self.length - size + 1, None]
            found = vocabulary.table.at(mixed(h.ravel())).reshape(h.shape)
            # every letter is an edge, if an unknown one; its id is then -1
            row, word = np.nonzero(found >= 0) if size > 1 else (np.repeat(np.arange(self.length), self.n), np.tile(np.arange(self.n), self.length))
            ids = found[row, word]
            cut = np.searchsorted(row, np.arange(self.length - size + 2))
            for i, (x, y) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)):
                if y > x:
                    by_end[i + size].append((i, word[x:y], ids[x:y]))
        self.edges = [(i, j, some, ids) for j, own in enumerate(by_end) for i, some, ids in own]


class Lattice:
    """Words of like length, padded at their ends, in spans of SPAN letters: the pieces of
    one span at a time are known, so that a word may be as long as it likes."""

    def __init__(self, vocabulary: Vocabulary, letters: np.ndarray, ends: np.ndarray):
        self.vocabulary, self.letters, self.ends = vocabulary, letters, ends
        self.n, self.length = letters.shape
        self.words = np.arange(self.n)
        self.kept: tuple[int, Group] | None = None

    def span(self, first: int) -> tuple[int, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """(low, edges) of the pieces that end after first and within its span; places count from low."""
        low = max(first - self.vocabulary.longest, 0)
        if self.kept is None or self.kept[0] != first:
            self.kept = first, Group(self.vocabulary, self.letters[:, low : first + SPAN])
        edges = self.kept[1].edges
        return low, edges if low == first else [e for e in edges if e[1] > first - low]

    def forward(self, log_p: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """Log of the sum over all segmentations of each word, for each row of log_p, which
        has the unknown's at its end. keep: takes the sums of the first row up to every letter."""
        out = np.empty((log_p.shape[0], self.n))
        carry = np.zeros((1, log_p.shape[0], self.n))
        for first in range(0, self.length, SPAN):
            low, edges = self.span(first)
            last = min(first + SPAN, self.length)
            alpha = np.full((last - low + 1, log_p.shape[0], self.n), -np.inf)
            alpha[: first - low + 1] = carry[-(first - low + 1) :]
            for i, j, some, ids in edges:
                if len(some) == self.n:
                    np.logaddexp(alpha[j], alpha[i] + log_p[:, ids], out=alpha[j])
                else:
                    alpha[j][:, some] = np.logaddexp(alpha[j][:, some], alpha[i][:, some] + log_p[:, ids])
            done = self.words[(self.ends > first) & (self.ends <= last)]
            out[:, done] = alpha[self.ends[done] - low, :, done].T
            if keep is not None:
                keep[low : last + 1] = alpha[:, 0]
            carry = alpha[-(self.vocabulary.longest + 1) :]
        return out

    def counts(self, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of times that each piece is used, over words that occur times often."""
        alpha = np.empty((self.length + 1, self.n))
        whole = self.forward(log_p[None], alpha)[0]
        beta = np.full((self.length + 1, self.n), -np.inf)
        beta[self.ends, self.words] = 0
        out = np.zeros(len(log_p))
        for first in reversed(range(0, self.length, SPAN)):
            low, edges = self.span(first)
            for i, j, some, ids in reversed(edges):
                onward = beta[low + j, some] + log_p[ids]
                beta[low + i, some] = np.logaddexp(beta[low + i, some], onward)
                share = np.exp(alpha[low + i, some] + onward - whole[some]) * times[some]
                np.add.at(out, ids, share)
        return out


def with_unknown(log_p: np.ndarray) -> np.ndarray:
    return np.r_[log_p, UNKNOWN]


def groups(vocabulary: Vocabulary, cp: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(indices of words, Lattice) of words of one length, or of lengths within a fourth
    of each other where they are over SHORT, in portions that bound the memory."""
    size = end - start
    if not len(size):
        return
    order = np.argsort(size, kind="stable")
    kind = np.where(size <= SHORT, size, SHORT + 1 + np.log(np.maximum(size, SHORT) / SHORT) // np.log(1.25)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, np.diff(kind[order]) > 0, True])
    for a, b in zip(cut, cut[1:], strict=False):
        step = max(1, 400_000 // int(size[order[b - 1]]))
        for k in range(a, b, step):
            own = order[k : min(k + step, b)]
            n = size[own]
            place = np.arange(int(n.max()))
            letters = np.zeros((len(own), len(place) + 1), np.uint32)
            letters[:, 0] = ord(MARK)
            inside = place < n[:, None]
            letters[:, 1:][inside] = cp[(start[own][:, None] + place)[inside]]
            yield own, Lattice(vocabulary, letters, n + 1)


class Memo:
    """Scores of words by hash, in sorted tables of doubling sizes; emptied when MOST words are in it."""

    MOST = 1_000_000

    def __init__(self):
        self.levels: list[tuple[Table, np.ndarray]] = []

    def get(self, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(width, words) scores, and the indices of words that have none here."""
        out = np.empty((width, len(h)))
        rest = np.arange(len(h))
        for table, values in self.levels:
            at = table.at(h[rest])
            hit = at >= 0
            out[:, rest[hit]] = values[:, at[hit]]
            rest = rest[~hit]
        return out, rest

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Sorted hashes that are not in it yet."""
        if not len(h):
            return
        if sum(len(t.keys) for t, _ in self.levels) > self.MOST:
            self.levels = []
        while self.levels and len(self.levels[-1][0].keys) < 2 * len(h):
            table, own = self.levels.pop()
            h, values = np.concatenate([table.keys, h]), np.concatenate([own, values], 1)
            order = np.argsort(h, kind="stable")
            h, values = h[order], values[:, order]
        self.levels.append((Table(h), values))


def word_scores(vocabulary: Vocabulary, texts: list[str], log_ps: list[np.ndarray], memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(texts, len(log_ps)) log probabilities of the texts, and the characters scored, a
    mark for each word included. memo: of earlier calls with the same log_ps."""
    w = Words(texts, raw=True)
    start, end, h, text = w.start, w.end, w.hash, w.text
    out = np.zeros((len(texts), len(log_ps)))
    letters = np.bincount(text, end - start + 1, len(texts)).astype(np.int64)
    if len(h):
        cp = Words.points(texts)
        memo, log_p = memo or Memo(), np.stack(log_ps)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        values, new = memo.get(unique, len(log_ps))
        for own, group in groups(vocabulary, cp, start[first[new]], end[first[new]]):
            values[:, new[own]] = group.forward(log_p)
        memo.add(unique[new], values[:, new])
        for k in range(len(log_ps)):
            out[:, k] = np.bincount(text, values[k][inverse], len(texts))
    return out, letters


def word_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, word and n: how often each word occurs in the texts of each key."""

    def count(batches):
        for batch in batches:
            keys = np.array(column(batch, key).to_pylist(), object)
            for first, texts in chunks(column(batch, "text").to_pylist()):
                own = keys[first : first + len(texts)]
                for name in sorted(set(own)):
                    some = [t for t, x in zip(texts, own, strict=True) if x == name]
                    w = Words(some, raw=True)
                    _, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                    flat = " " + " ".join(some) + " "
                    words = [flat[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(n.astype(np.int64))], [key, "word", "n"])

    return bounded(rows).where("text IS NOT NULL").select(key, "text").mapInArrow(count, f"{key} string, word string, n long").groupBy(key, "word").agg(F.sum("n").alias("n"))


def re_estimated(words: DataFrame, key: str, path: str, start: dict[str, np.ndarray], prior: float = 100.0) -> dict[str, np.ndarray]:
    """One step of expectation-maximisation over (key, word, n): by key, log
    probabilities of pieces from how often each is used in expectation over all
    segmentations, with prior uses spread as the vocabulary's own scores say."""
    held = words.sparkSession.sparkContext.broadcast((path, start))

    def expect(batches):
        path, start = held.value
        vocabulary = vocabulary_of(path).open()
        total = {k: np.zeros(len(v) + 1) for k, v in start.items()}
        for batch in batches:
            keys = np.array(column(batch, key).to_pylist(), object)
            text, n = np.array(column(batch, "word").to_pylist(), object), column(batch, "n").to_numpy().astype(float)
            for name in set(keys) & set(start):
                own = np.flatnonzero(keys == name)
                w = text[own]
                size = np.fromiter(map(len, w), np.int64, len(w))
                end = np.cumsum(size)
                cp = np.frombuffer("".join(w).encode("utf-32-le", "surrogatepass"), np.uint32)
                for some, group in groups(vocabulary, cp, end - size, end):
                    total[name] += group.counts(with_unknown(start[name]), n[own][some])
        for name, x in total.items():
            some = np.flatnonzero(x[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(x[some])], [key, "piece", "n"])

    out = words.mapInArrow(expect, f"{key} string, piece int, n double").groupBy(key, "piece").agg(F.sum("n").alias("n")).toArrow()
    base = np.exp(vocabulary_of(path).log_p)
    found = {k: prior * base for k in start}
    for k, piece, n in zip(out.column(key).to_pylist(), out.column("piece").to_pylist(), out.column("n").to_pylist(), strict=True):
        found[k][piece] += n
    return {k: np.log(v / v.sum()) for k, v in found.items()}

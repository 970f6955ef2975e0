"""Runs of periodic words by a suffix automaton with link-cut access.

Words enter a suffix automaton one by one. Its link tree is kept as paths whose nodes were last seen at the same word;
each path is a splay tree that knows this last place at its root. Appending word i walks the new prefix's
states up to the root. Where the walk leaves a path last seen at e, the deepest state met has a longest string of L
words that ended at e and now at i: with d = i - e <= L the L + d words up to i have period d, a square. It is
stretched left and right as far as the period holds. The walked states become one path seen at i. Every run
with two or more periods is met this way, at the word that completes its first square at the latest, and
d is always its least period.

Only stretches that can hold a wanted run enter an automaton: any five words in a row inside a run of at least six
words and four periods stand at least twice in the text. Stretches of words between other fives are left out,
which loses no run, and their cost is one hash per word.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_PERIODS = 4
_GRAM = 5
_ODD = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, _GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Run(NamedTuple):
    start: int
    length: int
    period: int


class LastSeen:
    """Suffix automaton of a growing word sequence; ``append`` tells which suffixes were last seen where."""

    def __init__(self) -> None:
        # state 0 is the empty string; a state with one edge has it in ``word`` and ``to``, others in ``more``
        self.size, self.link, self.word, self.to = (array("i", [v]) for v in (0, -1, -1, -1))
        self.more: dict[int, dict[int, int]] = {}
        self.left, self.right, self.up = (array("i", [-1]) for _ in range(3))  # splay trees of paths; a root's ``up`` is the state above its path
        self.seen = array("i", [-1])  # of a path's root: where its states were last seen
        self.last, self.count = 0, 0

    def _state(self, size: int, link: int) -> int:
        for column, value in ((self.size, size), (self.link, link), (self.word, -1), (self.to, -1), (self.left, -1), (self.right, -1), (self.up, -1), (self.seen, -1)):
            column.append(value)
        return len(self.size) - 1

    def _splay(self, x: int) -> None:
        """Makes ``x`` the root of its path's tree, which keeps what the old root knew."""
        left, right, up, seen = self.left, self.right, self.up, self.seen
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            turns = (x,) if not inner else (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            for c in turns:
                b = up[c]
                a = up[b]
                if left[b] == c:
                    m = left[b] = right[c]
                    right[c] = b
                else:
                    m = right[b] = left[c]
                    left[c] = b
                if m >= 0:
                    up[m] = b
                up[b], up[c] = c, a
                if a >= 0 and left[a] == b:
                    left[a] = c
                elif a >= 0 and right[a] == b:
                    right[a] = c
                else:
                    seen[c] = seen[b]

    def _extend(self, word: int) -> None:
        size, link, words, to, more = self.size, self.link, self.word, self.to, self.more
        new = self._state(size[self.last] + 1, 0)
        p, q = self.last, -1
        while p >= 0:
            if words[p] == word:
                q = to[p]
                break
            if words[p] < 0:
                words[p], to[p] = word, new
            else:
                edges = more.setdefault(p, {})
                q = edges.setdefault(word, new)
                if q != new:
                    break
                q = -1
            p = link[p]
        if p >= 0:
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                # a state between q and its link, on q's path and so last seen where q was
                self._splay(q)
                clone = self._state(size[p] + 1, link[q])
                words[clone], to[clone] = words[q], to[q]
                if q in more:
                    more[clone] = dict(more[q])
                above = self.left[q]
                self.left[clone], self.up[clone], self.left[q] = above, q, clone
                if above >= 0:
                    self.up[above] = clone
                while p >= 0:
                    if words[p] == word and to[p] == q:
                        to[p] = clone
                    elif p in more and more[p].get(word) == q:
                        more[p][word] = clone
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = clone
        self.up[new] = link[new]
        self.last = new

    def append(self, word: int) -> list[tuple[int, int]]:
        """(e, L) per path met from the new prefix up: the L last words were last seen ending at word e."""
        self._extend(word)
        place, met = self.count, []
        self.count += 1
        x, below = self.last, -1
        while x >= 0:
            self._splay(x)
            if self.seen[x] >= 0:
                met.append((self.seen[x], self.size[x]))
            cut = self.right[x]
            if cut >= 0:  # the rest of that path stays as it was seen
                self.seen[cut] = self.seen[x]
            self.right[x] = below
            below, x = x, self.up[x]
        self.seen[below] = place
        return met


def _same(words: list[int], at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, stepping forwards or back, equal the one a period away on the known side."""
    n, told, size = len(words), 0, 1
    while size:
        if step > 0:
            a, b = at + told, at + told + size
            equal = b <= n and words[a:b] == words[a - period : b - period]
        else:
            a, b = at - told - size + 1, at - told + 1
            equal = a >= 0 and words[a:b] == words[a + period : b + period]
        if equal:
            told += size
            size *= 2
        elif size > 1:
            # the end lies within: halve until single words tell
            size //= 2
            while size:
                if step > 0:
                    a, b = at + told, at + told + size
                    equal = b <= n and words[a:b] == words[a - period : b - period]
                else:
                    a, b = at - told - size + 1, at - told + 1
                    equal = a >= 0 and words[a:b] == words[a + period : b + period]
                if equal:
                    told += size
                size //= 2
        else:
            size = 0
    return told


def _stretch_runs(words: list[int], least_words: int, least_periods: int) -> Iterator[Run]:
    seen, ends = LastSeen(), {}
    for i, word in enumerate(words):
        for e, length in seen.append(word):
            period = i - e
            if period > length or ends.get(period, -1) >= i:
                continue
            first = i - length - period + 1
            end = i + _same(words, i + 1, period, 1)
            start = first - _same(words, first - 1, period, -1)
            ends[period] = end
            if end - start + 1 >= max(least_words, least_periods * period):
                yield Run(start, end - start + 1, period)


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches that hold every run: fives of words that stand twice, and the words they cover."""
    n = len(ids) - _GRAM + 1
    if n <= 1:
        return []
    gram = np.zeros(n, np.uint64)
    for k in range(_GRAM):
        gram = (gram ^ (gram >> np.uint64(31))) * _ODD[k] + ids[k : k + n].astype(np.uint64)
    _, back, held = np.unique(gram, return_inverse=True, return_counts=True)
    twice = held[back] > 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.view(np.int8), [0]])))
    return [(a, b + _GRAM - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def runs_of(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs of at least ``least_words`` words (6 or more) and ``least_periods`` periods (4 or more), by start, then period."""
    if least_words < LEAST_WORDS or least_periods < LEAST_PERIODS:
        raise ValueError("shorter runs may hold five words in a row that stand once")
    if len(words) < least_words:
        return []
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    found = [Run(a + r.start, r.length, r.period) for a, b in _stretches(ids) if b - a >= least_words for r in _stretch_runs(ids[a:b].tolist(), least_words, least_periods)]
    return sorted(found, key=lambda r: (r.start, r.period))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words outside the runs and each run's first period; a word that any run repeats goes."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r.start + r.period] += 1
        gone[r.start + r.length] -= 1
    return [w for w, n in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if n == 0]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


Alter = Callable[[int | None, list[bytes]], list[bytes]]

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, alter: Alter | None = None) -> DataFrame:
    """One row of SCHEMA for every row of ``docs`` (doc_id, text): how many runs, the strongest, and digests of all
    runs and of the words that stay. ``alter`` changes a row's words first.

    A null or empty text has no words and no runs. Repeated rows give a row each; a null doc_id is kept. An empty table
    gives no rows. Further columns are not read. A text is held whole, one at a time; a word of a repeating stretch costs
    about 100 bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # bytes split at blank and 0x09-0x0D alone
                if alter:
                    words = alter(doc_id, words)
                runs = runs_of(words)
                best = strongest(runs)
                listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
                top = (None,) * 4 if best is None else (*best, 1000 * best.length // best.period)
                rows.append((len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            made = [pa.array(v, pa.int64() if k < 5 else pa.string()) for k, v in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int64() if k < 5 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return _texts(docs).mapInArrow(run, SCHEMA)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) for every run of every row of ``docs`` (doc_id, text), in words from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for r in runs_of((t.as_py() or b"").split())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "length", "period"])

    return _texts(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def without_repetition(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with each run of ``text`` cut to its first period; a text without runs keeps its
    white space, another one has its words joined by one blank. A null text stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                words = (text or "").encode().split()
                runs = runs_of(words)
                out.append(b" ".join(collapsed(words, runs)).decode() if runs else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the checksum of its id, repeats a stretch of its words from some word on."""
    if doc_id is None or not words:
        return words
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % period] for i in range(a, n)]

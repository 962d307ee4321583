"""Runs of words: maximal stretches that repeat with a period, found in each text by internal pattern matching.

Blocks of 2^k words at multiples of 2^k are looked up in windows of their neighbourhood: a block's occurrences are one
range of the suffix array, and a wavelet tree over that array gives those of the range that start in a window, in order.
They are an arithmetic progression, whose terms, or whose ends where it has three terms or more, are candidate periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has so many words and so many times its period at least. Blocks of 2^FIRST words and the windows below rely on both.
LEAST_WORDS, LEAST_PERIODS = 24, 3
FIRST = 3


class Suffixes:
    """ranks[k][i]: the number of suffixes whose first 2^k words are less than those of suffix i; sizes[k][i]: how many
    suffixes have the same. The last level tells all suffixes apart. Suffixes that are too short are equal to no other."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.ranks: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.array = self._level(words.astype(np.int64))

    def _level(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        inner = keys[order]
        first = np.flatnonzero(np.concatenate(([True], inner[1:] != inner[:-1])))
        size = np.diff(np.append(first, self.n))
        rank, same = np.full(self.n + 1, -1, np.int32), np.zeros(self.n, np.int32)
        rank[order], same[order] = np.repeat(first, size), np.repeat(size, size)
        self.ranks.append(rank)
        self.sizes.append(same)
        return order

    @property
    def apart(self) -> bool:
        return int(self.sizes[-1].max()) == 1

    def double(self) -> None:
        rank, half = self.ranks[-1].astype(np.int64), 1 << (len(self.ranks) - 1)
        after = np.full(self.n, -1, np.int64)
        after[: max(self.n - half, 0)] = rank[half : self.n]
        self.array = self._level(rank[: self.n] * (self.n + 1) + after + 1)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j differ."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j; i is less than j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            there = i >= 1 << k
            a, b = np.where(there, i - (1 << k), 0), np.where(there, j - (1 << k), 1)
            step = (there & (self.ranks[k][a] == self.ranks[k][b])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i


class WaveletTree:
    """Over numbers below their count: for each bit from the highest, how many of a prefix of the level have a zero there."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        level = values.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            one = (level >> bit) & 1
            self.zeros.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(1 - one, dtype=np.int32))))
            level = np.concatenate((level[one == 0], level[one == 1]))

    def _walk(self, lo: np.ndarray, hi: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = zeros[lo], zeros[hi]
        return np.where(ones, zeros[-1] + lo - a, a), np.where(ones, zeros[-1] + hi - b, b), b - a

    def less(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers in [lo, hi) are less than x."""
        count, whole = np.zeros(len(lo), np.int64), x >> self.bits > 0
        every = hi - lo
        for level, zeros in enumerate(self.zeros):
            ones = (x >> (self.bits - 1 - level)) & 1 == 1
            lo, hi, less = self._walk(lo, hi, ones, zeros)
            count += np.where(ones, less, 0)
        return np.where(whole, every, count)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number in [lo, hi) that k others there are less than: the range successor of x for k = less(x)."""
        found = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            less = zeros[hi] - zeros[lo]
            ones = k >= less
            lo, hi, _ = self._walk(lo, hi, ones, zeros)
            k = np.where(ones, k - less, k)
            found |= ones.astype(np.int64) << (self.bits - 1 - level)
        return found


def _candidates(suffixes: Suffixes, tree: WaveletTree, k: int, blocks: np.ndarray, near: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) from the occurrences of blocks (of 2^k words, from their places) that start near to far words later.

    Of three occurrences or more, r words apart, all are in one stretch of period r. If the block is in that stretch too,
    r is the period of what they are in, found with smaller blocks; else the ends of its own stretch of period r must meet
    those of the occurrences', on one side at least.
    """
    lo = suffixes.ranks[k][blocks].astype(np.int64)
    hi = lo + suffixes.sizes[k][blocks]
    skip = tree.less(lo, hi, blocks + near)
    number = tree.less(lo, hi, blocks + far) - skip
    some = number > 0
    blocks, lo, hi, skip, number = (x[some] for x in (blocks, lo, hi, skip, number))
    if not len(blocks):
        return
    first = tree.kth(lo, hi, skip)
    many = (number > 2) if far - near >= 1 << FIRST else np.zeros(len(blocks), bool)
    yield blocks[~many], (first - blocks)[~many]
    for more in range(1, int(number[~many].max(initial=0))):
        on = ~many & (number > more)
        yield blocks[on], tree.kth(lo[on], hi[on], skip[on] + more) - blocks[on]
    if many.any():
        at, there = blocks[many], first[many]
        apart = tree.kth(lo[many], hi[many], skip[many] + 1) - there
        for shift in (suffixes.ahead(there, there + apart) + there - suffixes.ahead(at, at + apart) - at, there - suffixes.behind(there, there + apart) - at + suffixes.behind(at, at + apart)):
            fits = (shift >= near) & (shift < far)
            yield at[fits], shift[fits]


def runs(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of a text of numbered words, by start and period.

    A run of smallest period q has LEAST_WORDS words and LEAST_PERIODS * q at least, and no neighbouring word extends it.
    With 2^k <= q < 2^(k + 1), its first 2 q words hold a whole block, which comes again q words later; runs of periods
    below 2^FIRST are long enough to hold a block of 2^FIRST words and its next occurrence.
    """
    none, n = np.zeros((0, 3), np.int64), len(words)
    if n < LEAST_WORDS:
        return none
    suffixes = Suffixes(words)
    while len(suffixes.ranks) <= FIRST and not suffixes.apart:
        suffixes.double()
    if len(suffixes.ranks) <= FIRST or int(suffixes.sizes[FIRST][: n - n % (1 << FIRST) : 1 << FIRST].max(initial=1)) < 2:
        return none
    while not suffixes.apart:
        suffixes.double()
    tree = WaveletTree(suffixes.array)
    found = []
    for k in range(FIRST, len(suffixes.ranks)):
        if LEAST_PERIODS << k > n:
            break
        blocks = np.arange(0, n - (1 << k) + 1, 1 << k)
        blocks = blocks[suffixes.sizes[k][blocks] > 1]
        for near, far in [(1, 1 << FIRST)] * (k == FIRST) + [(1 << k, 2 << k)]:
            for at, period in _candidates(suffixes, tree, k, blocks, near, far):
                start = at - suffixes.behind(at, at + period)
                length = at + period + suffixes.ahead(at, at + period) - start
                fits = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
                found.append(np.stack((start, length, period), 1)[fits])
    every = np.concatenate(found) if found else none
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # the same stretch with a multiple of its smallest period
    every = every[np.concatenate(([True], (every[1:, :2] != every[:-1, :2]).any(1)))] if len(every) else every
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps[:n]) == 0


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        counts, lists, texts = [], [], []
        for text in batch.column(1).cast(pa.large_binary()):
            words = (text.as_py() or b"").split()
            found = runs(pd.factorize(np.array(words, object))[0]) if len(words) >= LEAST_WORDS else np.zeros((0, 3), np.int64)
            counts.append(len(words))
            lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
            texts.append(b" ".join([w for w, stays in zip(words, kept(len(words), found).tolist(), strict=True) if stays] if len(found) else words))
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, n_words, runs, an array of (start, length, period) by start and period, and collapsed, the text's
    words without those that repeat, joined by blanks. Words are split at white space of ASCII; starts count from 0.

    A null or blank text has no words, no runs and is collapsed to an empty one. Repeated rows and ids give a row each;
    an empty table gives none; other columns of ``docs`` are not read, whatever their names. No shuffle. A task's memory
    grows with the longest text, by about 8 bytes for each of its words and each doubling up to its longest repeat.
    """
    own = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    schema = f"id {dict(own.dtypes)['id']}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return own.mapInArrow(_found, schema).withColumnRenamed("id", id_column)

"""Arrays over the UTF-8 bytes of a batch of texts: words, spans' hashes, GPT-style pre-tokens.

All functions see a batch as ``data`` (uint8, the texts end to end) and ``offsets`` (int64, text i is
``data[offsets[i]:offsets[i + 1]]``). They allocate some tens of bytes for each byte of text, so callers
cut a batch with ``pieces``; a single text is never cut, so memory also grows with the longest text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

U64 = np.uint64


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; each has at least one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15)) | U64(1)


class SpanHash:
    """64-bit hashes of byte spans from one running sum: polynomials modulo 2^64 with an odd base.

    A span's sum is divided by the power at its start, as odd numbers have an inverse modulo 2^64.
    """

    def __init__(self, seed: int):
        self.base = int(constants(1, seed)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.letters = constants(256, seed + 1)
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n + 1 + n // 4, U64(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


@lru_cache
def span_hash(seed: int) -> SpanHash:
    return SpanHash(seed)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; and, as offsets, which words are text i's."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    begins = word[1:-1] & ~word[:-2]
    closes = word[1:-1] & ~word[2:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] |= word[inner + 1]
    closes[inner - 1] |= word[inner]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


# Classes of characters in the pre-token pattern.
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = LETTER if kind == "L" else NUMBER
    # The characters of the Unicode property White_Space.
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """For each byte the class of its character."""
    table = _classes()
    out = table[:256][data]
    leads = np.flatnonzero(data >= 0xC0)
    if len(leads):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        a, b, c, d = (padded[leads + k] for k in range(4))
        two, three = a < 0xE0, a < 0xF0
        cp = np.where(two, (a & 0x1F) << 6 | b & 0x3F, np.where(three, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F, (a & 0x07) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F))
        kind = table[np.minimum(cp, 0x10FFFF)]
        out[leads] = kind
        for k, has in ((1, slice(None)), (2, ~two), (3, ~three)):
            at, of = leads[has] + k, kind[has]
            out[at[at < len(out)]] = of[at < len(out)]
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the byte-level BPE pattern; and, as offsets, which are text i's.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    Runs of one class are cut first; then a run of white space before other text gives its last character
    to itself, or, if that is U+0020, to the next run; then the seven endings are cut after an apostrophe
    that starts a token.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _byte_classes(data)
    first = np.ones(n, bool)  # first bytes of tokens
    first[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first |= edge[:n]
    runs = np.flatnonzero(first)
    ends = np.append(runs[1:], n)
    spaces = (kind[runs] == SPACE) & ~edge[ends]
    after = ends[spaces]
    last = after - 1
    for _ in range(3):  # back to the first byte of the last character
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    first[last] = True
    first[after[data[last] == 0x20]] = False
    quotes = np.flatnonzero((data == 0x27) & first)
    if len(quotes):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        room = offsets[np.searchsorted(offsets, quotes, "right")] - quotes  # bytes to the text's end
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (room >= 2)
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        two &= (room >= 3) & ~one
        for mask, size in ((one, 2), (two, 3)):
            at = quotes[mask]
            first[at + 1] = False
            at = at[at + size < n] + size
            first[at] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct spans: sorted hashes, an example's index for each, and for each span its distinct one.

    Raises if spans with equal hashes differ in a second, independent hash.
    """
    keys, example, which = np.unique(span_hash(11)(data, starts, ends), return_index=True, return_inverse=True)
    check = span_hash(23)(data, starts, ends)
    if not np.array_equal(check, check[example][which]):
        raise ValueError("two different tokens of a batch have the same 64-bit hash")
    return keys, example, which


def spans_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[offsets[i]:offsets[i + 1]]`` for i in ``which``, end to end, and their offsets."""
    sizes = np.diff(offsets)[which]
    out = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(out[-1]) + np.repeat(offsets[:-1][which] - out[:-1], sizes)
    return values[index], out

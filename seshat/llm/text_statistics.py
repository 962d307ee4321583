"""Counts over whole texts that the quality rules use."""

from __future__ import annotations

import numpy as np

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
WINDOW = 8

#: Columns of ``statistics``, all counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_stops", "n_letters", "n_digits", "n_same_next")

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


_STEPS = np.uint64(0x9E3779B97F4A7C15) ** np.arange(WINDOW, dtype=np.uint64)


def _repeat_words(ids: np.ndarray) -> int:
    """Words in windows of WINDOW words found twice or more, each word once; ids: equal for equal words."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    wide = ids.astype(np.uint64)
    sums = sum(wide[k : k + n] * step for k, step in enumerate(_STEPS))
    if len(np.unique(sums)) == n:  # equal windows have equal sums
        return 0
    size = 1
    while size < WINDOW:  # number the pairs of equal halves: equal numbers are equal windows
        pairs = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        _, ids = np.unique(pairs, return_inverse=True)
        size *= 2
    hit = np.bincount(ids)[ids] > 1
    at = np.flatnonzero(hit)
    change = np.zeros(n + WINDOW, np.int64)
    change[at] += 1
    change[at + WINDOW] -= 1
    return int((np.cumsum(change) > 0).sum())


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += bool(line.strip(_SPACES))
        else:
            seen.add(line)
    return n


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; a null text counts as an empty one. Words are ``[^\\x20\\x09-\\x0D]+``."""
    raw = (text or "").encode()
    words = raw.split()
    solid = raw.translate(None, _SPACES)
    chars = len(text or "") - (len(raw) - len(solid))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return (
        len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), _dup_lines(raw), _repeat_words(ids),
        raw.count(b"\n") + 1, len(number), raw.count(b"."), len(raw) - len(raw.translate(None, _LETTERS)),
        len(raw) - len(raw.translate(None, b"0123456789")), int(np.count_nonzero(ids[1:] == ids[:-1])),
    )

"""Token counts at every prefix by dynamic programming over byte-level BPE.

The last token of the encoding of a prefix fixes the encoding: it is the one token t that ends there and
leaves the pair (last token before t, t) as it is when the two are encoded together. So one pass over the
ends of a word fills a table with the last token and the count of each prefix, and a text's count, a count
at any prefix, or a cut at a budget are sums and look-ups in these tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batch import distinct_spans, pieces, pre_tokens, spans_bytes, utf8

#: Distinct words whose tables a worker keeps; then it starts anew.
CACHE_WORDS = 1_000_000


#: White space as in the pre-token pattern.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _alphabet() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts of a vocabulary file of the tokenizers library (byte-level BPE without a normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _alphabet()
        spell = lambda s: bytes(byte[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(spell(a), spell(b)): k for k, (a, b) in enumerate(pairs)}
        self.parts = {a + b: (a, b, k) for (a, b), k in reversed(self.ranks.items())}
        tokens = {spell(t) for t in spec["model"]["vocab"]}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._spines: dict[bytes, tuple[list, list]] = {}
        self._stable: dict[tuple[bytes, bytes], bool] = {}
        self._totals: dict[int, int] = {}
        self.tokens: set[bytes] = set()
        for token in sorted(tokens, key=len):  # those that the merges make
            if len(token) == 1:
                self.tokens.add(token)
            elif token in self.parts:
                a, b, rank = self.parts[token]
                if a in self.tokens and b in self.tokens and not self._joins(a, b, rank):
                    self.tokens.add(token)
        self.longest = max(map(len, self.tokens))

    def _spine(self, token: bytes) -> tuple[list, list]:
        """The pieces that stand at the token's right end and at its left end as it is merged, each with the
        rank of the merge that takes it in."""
        found = self._spines.get(token)
        if found is None:
            sides = []
            for side in (1, 0):
                piece, until, pieces_ = token, len(self.ranks), []
                while True:
                    pieces_.append((piece, until))
                    if piece not in self.parts:
                        break
                    until, piece = self.parts[piece][2], self.parts[piece][side]
                sides.append(pieces_)
            found = self._spines[token] = (sides[0], sides[1])
        return found

    def _joins(self, a: bytes, b: bytes, before: int) -> bool:
        """Whether, as a and b are merged side by side, a merge of lower rank than ``before`` takes from both.

        A merge's rank is above the ranks of those that make its parts, so merges run in order of rank, and
        two pieces that meet at the border are joined if their own rank comes before what takes them in;
        equal ranks go from left to right.
        """
        get, none = self.ranks.get, len(self.ranks)
        for left, la in self._spine(a)[0]:
            for right, lb in self._spine(b)[1]:
                rank = get((left, right), none)
                if rank < before and rank < la and rank <= lb:
                    return True
        return False

    def _keeps(self, a: bytes, b: bytes) -> bool:
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) > CACHE_WORDS // 2:
                self._stable.clear()
            known = self._stable[a, b] = not self._joins(a, b, len(self.ranks))
        return known

    def tables(self, words: list[bytes]) -> Iterator[list[int]]:
        """For each word, of one pre-token, the tokens of word[:i] for each i. Sorted words share their prefixes' entries."""
        counts: list[int] = [0]
        last: list[bytes] = [b""]
        before = b""
        tokens, longest = self.tokens, self.longest
        for word in words:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = word[start:end]
                    if token in tokens and (not start or self._keeps(last[start], token)):
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            before = word
            yield counts

    def table(self, word: bytes) -> list[int]:
        return next(self.tables([word]))

    def totals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a batch, texts without special strings."""
        starts, ends, which = pre_tokens(data, offsets)
        keys, example, inverse = distinct_spans(data, starts, ends)
        if len(self._totals) > CACHE_WORDS:
            self._totals.clear()
        known = [self._totals.get(k, -1) for k in keys.tolist()]
        counts = np.array(known, np.int64)
        new = np.flatnonzero(counts < 0)
        words = spans_bytes(data, starts[example[new]], ends[example[new]])
        order = sorted(range(len(words)), key=words.__getitem__)
        for k, table in zip(order, self.tables([words[k] for k in order]), strict=True):
            counts[new[k]] = self._totals[int(keys[new[k]])] = table[-1]
        sums = np.concatenate([[0], np.cumsum(counts[inverse])])
        return sums[which[1:]] - sums[which[:-1]]

    def count(self, text: str) -> int:
        return int(self.counts(pa.array([text]))[0])

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; each special string is one token and cuts the text; null has none."""
        data, offsets = utf8(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        marks = [s.encode() for s in self.special]
        if any(m in raw for m in marks):
            for k in range(len(out)):
                parts = [raw[offsets[k] : offsets[k + 1]]]
                for m in marks:
                    parts = [x for p in parts for x in p.split(m)]
                    out[k] = len(parts) - 1
                d, o = utf8(pa.array(parts, pa.binary()))
                out[k] += self.totals(d, o).sum()
            return out
        for lo, hi in pieces(offsets):
            out[lo:hi] = self.totals(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        return out

    def _plain_prefix_counts(self, text: str) -> list[int]:
        """prefix_counts of a text in which no special string counts as one."""
        data, offsets = utf8(pa.array([text]))
        starts, ends, _ = pre_tokens(data, offsets)
        out = [0]
        for word in spans_bytes(data, starts, ends):
            table, before, at = self.table(word), out[-1], 0
            for k, char in enumerate(word.decode()):
                at += len(char.encode())
                out.append(before + table[at])
                if k == 1 and word in (b"'re", b"'ve", b"'ll"):
                    out[-1] = before + 2
        for run in _BLANKS.finditer(text):
            table, at = self.table(run[0].encode()), 0
            for k, char in enumerate(run[0]):
                at += len(char.encode())
                out[run.start() + k + 1] = out[run.start()] + table[at]
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[i]: tokens of text[:i] encoded alone, for each i up to the text's length.

        The tables of the text's words answer. Prefixes of two kinds are cut otherwise than the text: all
        white space at a prefix's end is one word, and a prefix that ends inside 're, 've or 'll has two
        words there. Until a special string is complete, its letters are ordinary text.
        """
        out, before = [0], 0
        marks = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for part, mark in zip(marks[::2], [*marks[1::2], None], strict=True):
            own = self._plain_prefix_counts(part + (mark[:-1] if mark else ""))
            out += [before + c for c in own[1:]]
            if mark:
                before += own[len(part)] + 1
                out.append(before)
        return np.array(out, np.int64)

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a worker process and file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, n_bytes (UTF-8) and n_tokens; exact for whole texts.

    vocabulary: path of the vocabulary file, on every machine. A null text counts as an empty one and has 0
    of both. Repeated rows and ids give a row each; an empty table gives none; other columns of ``docs``
    are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(0))
            yield pa.record_batch([batch.column(1), pa.array(np.diff(offsets)), pa.array(counter(vocabulary).counts(batch.column(0)))], names=["id", "n_bytes", "n_tokens"])

    texts = docs.select(docs[text_column].alias("text"), docs[id_column].alias("id"))
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_column)


def truncate(docs: DataFrame, vocabulary: str, budget: int, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, the longest prefix of the text with at most ``budget`` tokens, and its n_tokens.

    Nulls, repeated rows, empty tables and other columns are treated as in ``count``; the prefix of a null
    text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes = [], []
            for text in batch.column(0).to_pylist():
                counts = counter(vocabulary).prefix_counts(text or "")
                at = int(np.flatnonzero(counts <= budget)[-1])
                kept.append((text or "")[:at])
                sizes.append(int(counts[at]))
            yield pa.record_batch([batch.column(1), pa.array(kept, pa.string()), pa.array(sizes, pa.int64())], names=["id", "text", "n_tokens"])

    texts = docs.select(docs[text_column].alias("text"), docs[id_column].alias("id"))
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, text string, n_tokens bigint").withColumnRenamed("id", id_column)

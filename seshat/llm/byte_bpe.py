"""Byte-level BPE over a corpus: each distinct word is encoded once, after a shuffle of distinct words.

1. Documents are taken in blocks of about BLOCK_BYTES. A block's distinct pre-tokens leave it packed, one
   row for each partition that hashes of words go to.
2. There each distinct word is encoded once, whatever the number of blocks that sent it; ids go back to
   the blocks, packed likewise.
3. A block's texts, compressed, meet its ids; the positions of the block's pre-tokens put ids in order.

Decoding looks ids up in the table of tokens' bytes, which has as many rows as the vocabulary.

A block is known by a digest of its ids and texts, so a block that is read again and differs has no ids, and the
run fails instead of giving wrong ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame

from .batch import distinct_spans, gather, pieces, pre_tokens, spans_bytes, utf8

#: A block ends at about so many bytes or at so many texts.
BLOCK_BYTES, BLOCK_TEXTS = 4 << 20, 1 << 16
#: Words are dealt to at most so many partitions, as each block sends a row to each of them.
WORD_PARTS = 2048
#: Words whose ids a partition keeps; beyond, it forgets them all and encodes them again when they come again.
KNOWN_WORDS = 1 << 20

#: Splits a text before merges; fixed by the vocabulary. ``batch.pre_tokens`` finds its matches.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ZSTD = pa.Codec("zstd", 3)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _pack_slices(parts: list[bytes]) -> bytes:
    sizes = np.array(list(map(len, parts)), np.uint32)
    return _pack(len(parts).to_bytes(8, "little") + sizes.tobytes() + b"".join(parts))


def _unpack_slices(data: bytes) -> tuple[bytes, np.ndarray]:
    raw = _unpack(data)
    n = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, np.uint32, n, 8)
    return raw[8 + 4 * n :], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@lru_cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache
def encoding(path: str) -> tiktoken.Encoding:
    """Of words that are cut already: the pattern takes a whole text as one."""
    return tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes end to end, by id, and their offsets."""
    table = ranks(path)
    by_id = [b""] * (max(table.values()) + 1)
    for token, k in table.items():
        by_id[k] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, by_id)))])


class _Block:
    def __init__(self, ids: list, data: bytes, offsets: np.ndarray, id_type: pa.DataType | None = None):
        self.ids, self.data, self.offsets, self.id_type = ids, data, offsets, id_type

    @property
    def key(self) -> bytes:
        return xxhash.xxh3_128_digest(self.data + self.offsets.tobytes() + repr(self.ids).encode())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Texts (column 0) and ids (column 1) of a partition in blocks."""
    ids, parts, sizes, held = [], [], [], 0

    def flush() -> _Block:
        return _Block(ids, b"".join(parts), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), batch.schema.field(1).type)

    for batch in batches:
        data, offsets = utf8(batch.column(0))
        own = batch.column(1).to_pylist()
        for lo, hi in pieces(offsets):
            for a in range(lo, hi, BLOCK_TEXTS):
                b = min(a + BLOCK_TEXTS, hi)
                if ids and (held + offsets[b] - offsets[a] > BLOCK_BYTES or len(ids) + b - a > BLOCK_TEXTS):
                    yield flush()
                    ids, parts, sizes, held = [], [], [], 0
                ids += own[a:b]
                parts.append(data[offsets[a] : offsets[b]].tobytes())
                sizes += np.diff(offsets[a : b + 1]).tolist()
                held += int(offsets[b] - offsets[a])
    if ids:
        yield flush()


def _block_words(block: _Block) -> tuple[np.ndarray, list[bytes], list[np.ndarray], list[np.ndarray]]:
    """Sorted hashes of the block's distinct words, the words; for each piece, its tokens' words and texts' offsets."""
    data = np.frombuffer(block.data, np.uint8)
    keys, words, seen, cuts = [], [], [], []
    for lo, hi in pieces(block.offsets):
        part = data[block.offsets[lo] : block.offsets[hi]]
        starts, ends, texts = pre_tokens(part, block.offsets[lo : hi + 1] - block.offsets[lo])
        own, example, which = distinct_spans(part, starts, ends)
        keys.append(own)
        words += spans_bytes(part, starts[example], ends[example])
        seen.append(which)
        cuts.append(texts)
    every, example, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    chosen = [words[k] for k in example.tolist()]
    if any(words[k] != chosen[w] for k, w in enumerate(which.tolist())):
        raise ValueError("two different tokens of a block have the same 64-bit hash")
    at = np.concatenate([[0], np.cumsum(list(map(len, keys)))])
    return every, chosen, [which[a:][s] for a, s in zip(at, seen, strict=False)], cuts


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    part = (keys >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for k in range(parts):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k] : edges[k + 1]]


def _sent_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            keys, words, _, _ = _block_words(block)
            rows = [(k, _pack_slices([words[i] for i in own.tolist()])) for k, own in _by_part(keys, parts)]
            yield pa.record_batch([pa.array([block.key] * len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "part", "words"])

    return run


def _encoded_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        known: dict[bytes, bytes] = {}  # this partition's words
        for batch in batches:
            out = []
            for packed in batch.column(2).to_pylist():
                raw, offsets = _unpack_slices(packed)
                ids = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    word = raw[a:b]
                    got = known.get(word)
                    if got is None:
                        if len(known) == KNOWN_WORDS:
                            known.clear()
                        got = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    ids.append(got)
                out.append(_pack_slices(ids))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "part", "ids"])

    return run


def _sent_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        ids = pa.array([block.ids], pa.list_(block.id_type))
        yield pa.record_batch([pa.array([block.key], pa.binary()), ids, pa.array([_pack(block.offsets.astype("<i8").tobytes())], pa.binary()), pa.array([_pack(block.data)], pa.binary())], names=["block", "ids", "offsets", "texts"])


def _spelled(ids: bytes | None, vocabulary: str) -> bytes:
    """The bytes of a text's ids: each id's row of the table of tokens, end to end."""
    table, offsets = token_bytes(vocabulary)
    return gather(table, offsets, np.frombuffer(ids or b"", "<u4").astype(np.int64))[0].tobytes()


def _reassembled(parts: int, decoded_by: str | None):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        rows = texts.to_pylist()
        out_ids: list = []
        out: list[bytes] = []
        if rows:  # several rows: repeated blocks
            block = _Block([], _unpack(rows[0]["texts"]), np.frombuffer(_unpack(rows[0]["offsets"]), "<i8"))
            keys, _, tokens, cuts = _block_words(block)
            sent = {r["part"]: r["ids"] for r in words.to_pylist()}
            counts, flat, places = np.zeros(len(keys), np.int64), [], []
            for k, own in _by_part(keys, parts):
                if k not in sent:
                    raise ValueError("a block of documents differs between two reads of the input; write it to a table first")
                raw, offsets = _unpack_slices(sent[k])
                counts[own] = np.diff(offsets) // 4
                flat.append(np.frombuffer(raw, "<u4"))
                places.append(own)
            order = np.concatenate(places) if places else np.zeros(0, np.int64)
            by_word = np.zeros(len(keys) + 1, np.int64)
            by_word[1:] = np.cumsum(counts[order])
            all_ids = np.concatenate(flat) if flat else np.zeros(0, "<u4")
            at = np.empty(len(keys), np.int64)
            at[order] = np.arange(len(keys))
            encoded: list[bytes] = []
            for which, texts_at in zip(tokens, cuts, strict=True):
                ids, ends = gather(all_ids, by_word, at[which])
                edges = ends[texts_at].tolist()
                encoded += [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for r in rows:
                out_ids += r["ids"]
                out += encoded
        columns = {"id": pa.array(out_ids, texts.schema.field("ids").type.value_type), "ids": pa.array(out, pa.binary())}
        if decoded_by is not None:  # here, as a second Python stage would hold as much memory again
            columns["decoded"] = pa.array([_spelled(ids, decoded_by) for ids in out], pa.binary())
        return pa.table(columns)

    return run


def _encoded(docs: DataFrame, vocabulary: str, id_column: str, text_column: str, decoded: bool) -> DataFrame:
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), WORD_PARTS)
    source = docs.select(docs[text_column].alias("text"), docs[id_column].alias("id"))
    kind = dict(source.dtypes)["id"]
    words = source.mapInArrow(_sent_words(parts), "block binary, part int, words binary")
    ids = words.repartition(parts, "part").mapInArrow(_encoded_words(vocabulary), "block binary, part int, ids binary")
    texts = source.mapInArrow(_sent_texts, f"block binary, ids array<{kind}>, offsets binary, texts binary")
    joined = texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_reassembled(parts, vocabulary if decoded else None), f"id {kind}, ids binary" + ", decoded binary" * decoded)
    return joined.withColumnRenamed("id", id_column)


def encode(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id and ids, the token ids as little-endian unsigned 32-bit integers.

    vocabulary: path of the file of ranks, on every machine. ``docs`` is read twice and must be the same
    both times, as a table is. Ids can be of any type. A null or empty text has no ids. Repeated rows and ids give a row each; an
    empty table gives none; other columns of ``docs`` are not read, whatever their names.
    """
    return _encoded(docs, vocabulary, id_column, text_column, False)


def decode(encoded: DataFrame, vocabulary: str, *, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded: the bytes of its ids. Null ids give no bytes; unknown ids fail. No shuffle."""
    at = encoded.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_spelled(ids, vocabulary) for ids in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(parts, pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def encode_and_decode(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``encode``, with the bytes that the ids decode to."""
    return _encoded(docs, vocabulary, id_column, text_column, True)

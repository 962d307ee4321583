"""Line dedup over a corpus: long lines found in many documents stay in one of them.

Hashes of long lines are range-partitioned by key and document downwards, and sorted so and by position: a key that fills
many partitions is cut between documents. A key's first document is the one that keeps its lines;
as soon as a partition's stream has seen enough documents of a key, all later positions are to be dropped, and it sends
them on as it reads them. Only the first and the last key of a partition may go on in another one: their positions wait
for a table of those keys, of two rows a partition at most, which is broadcast. What comes back per document is a bitmap
of kept lines, packed and compressed, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import Staging

MIN_CHARS = 40
MIN_DOCUMENTS = 5

_SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null id while rows are sorted: below any id.
_NULL_ID = -(1 << 63)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    return line.strip(_SPACES).translate(_LOWER)


def _keyed_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, texts, lines = [], [], [], []
            for doc, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        keys.append(xxhash.xxh3_128_digest(key.encode()))
                        docs.append(doc)
                        texts.append(mark)
                        lines.append(k)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(texts, pa.int64()), pa.array(lines, pa.int32())], names=["key", "doc", "mark", "line"])

    return run


class _Stream:
    """Of one partition's rows, by key, document downwards and position: positions to drop, and what is open at its ends.

    Out come (key, doc, mark, line, n, largest): without a key, a position to drop; with a key and a line, a position of an
    open key; with a key and n, an open key's number of documents here and its largest one.
    """

    def __init__(self, min_documents: int):
        self.least, self.key, self.first = min_documents, None, True
        self.out: list[tuple] = []

    def _begin(self, key: bytes) -> None:
        self.key, self.n, self.largest, self.doc, self.held = key, 0, None, None, []

    def _end(self, last: bool) -> None:
        """Of the key that ends; the first and the last one of a partition stay open."""
        if self.key is not None and (self.first or last):
            self.out += [(self.key, doc, mark, line, None, None) for doc, mark, line in self.held]
            self.out.append((self.key, None, None, None, self.n, self.largest))
        self.first = self.first and self.key is None

    def _row(self, key: bytes, doc: int, mark: int, line: int) -> None:
        if key != self.key:
            self._end(False)
            self._begin(key)
        if doc != self.doc:
            if self.n == 0:
                self.largest = doc
            self.n, self.doc = self.n + 1, doc
            if self.n == self.least and not self.first:  # the key is common here: its largest document is this partition's
                self.out += [(None, *h, None, None) for h in self.held if h[0] != self.largest]
                self.held = []
        if self.first:  # it may have begun in another partition, with a larger document
            self.out.append((key, doc, mark, line, None, None))
        elif self.n < self.least:
            self.held.append((doc, mark, line))
        elif doc != self.largest:
            self.out.append((None, doc, mark, line, None, None))

    def _batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _FOUND, strict=True)], names=["key", "doc", "mark", "line", "n", "largest"])

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                self._row(*row)
            yield self._batch()
        self._end(True)
        yield self._batch()


_FOUND = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, n_lines, dropped lines) to keep bitmaps, of one bit a line, compressed."""
    for batch in batches:
        maps = []
        for dropped in batch.column(2).to_pylist():
            bits = np.ones((max(dropped) // 8 + 1) * 8, bool)
            bits[dropped] = False
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(map(len, batch.column(2).to_pylist())), pa.int64()), pa.array(maps, pa.binary())], names=["doc", "mark", "n_dropped", "keep"])


def _marked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc: the id; mark: a hash of the text, as two rows may have one id."""
    return docs.select(F.coalesce(docs[id_column].cast("bigint"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.coalesce(docs[text_column], F.lit(""))).alias("mark"), docs[text_column].alias("text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, mark, n_dropped, keep) for the documents that lose lines; keep is read by ``kept_lines``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` characters in at least ``min_documents`` documents stay only in the one with the largest
    id. Rows with one id count as one document. Null ids count as one document below all others.
    """
    staged = Staging(docs.sparkSession, "lines")
    rows = _marked(docs, id_column, text_column).mapInArrow(_keyed_lines(min_chars), "key binary, doc bigint, mark bigint, line int")
    rows = staged.write(rows, "rows")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "key", F.desc("doc")).sortWithinPartitions("key", F.desc("doc"), "line")
    streamed = dealt.mapInArrow(lambda batches: _Stream(min_documents).run(batches), "key binary, doc bigint, mark bigint, line int, n bigint, largest bigint")
    found = staged.write(streamed, "found")
    common = found.where("n IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).where(F.col("n") >= min_documents)
    open_ = found.where("key IS NOT NULL AND line IS NOT NULL").select("key", "doc", "mark", "line").join(F.broadcast(common.select("key", F.col("largest").alias("keeper"))), "key").where("doc <> keeper")
    dropped = found.where("key IS NULL").select("doc", "mark", "line").union(open_.select("doc", "mark", "line"))
    lists = dropped.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    out = staged.write(lists.mapInArrow(_bitmaps, "doc bigint, mark bigint, n_dropped bigint, keep binary"), "bitmaps")
    staged.drop("rows", "found")
    return out


def kept_lines(text: str | None, keep: bytes | None) -> str | None:
    """The text without the lines that the bitmap drops; lines beyond its end stay."""
    if keep is None:
        return text
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return "\n".join([x for k, x in enumerate(lines) if k >= len(bits) or bits[k]])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = list(map(kept_lines, batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()))
        columns = batch.columns[:-1]
        columns[at] = pa.array(texts, pa.string())
        yield pa.record_batch(columns, names=batch.schema.names[:-1])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, n_lines (before), n_dropped and the kept text.

    A null text has one empty line, which stays; so does an empty one. Repeated rows give a row each,
    all with the same lines kept. A document can lose all its lines: its text is then empty. An empty
    table gives no rows. Other columns of ``docs`` are not read, whatever their names. Ids are whole numbers of 64 bits, or
    strings of their digits; other strings end the run with CAST_INVALID_INPUT.
    """
    maps = keep_bitmaps(docs, min_chars, min_documents, id_column=id_column, text_column=text_column)
    joined = _marked(docs, id_column, text_column).join(maps.hint("shuffle_hash"), ["doc", "mark"], "left")  # texts are not sorted
    n_lines = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]+", "")) + 1
    flat = joined.select(
        F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias(id_column), n_lines.cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("text"), "keep",
    )
    return flat.mapInArrow(_applied, f"`{id_column}` bigint, n_lines bigint, n_dropped bigint, text string")


def dedup_rows(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, *, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``docs`` with all its rows and columns; texts lose the lines that ``dedup_lines`` drops.

    Texts that lose none stay as they are, null ones too; ``length_column``, if there is one, gets the new
    length in characters where lines went. Ids are as in ``dedup_lines``.
    """
    maps = keep_bitmaps(docs, min_chars, min_documents, id_column=id_column, text_column=text_column)
    named = maps.select(F.col("doc").alias("seshat_doc"), F.col("mark").alias("seshat_mark"), F.col("keep").alias("seshat_keep"))
    on = (F.coalesce(docs[id_column].cast("bigint"), F.lit(_NULL_ID)) == named["seshat_doc"]) & (F.xxhash64(F.coalesce(docs[text_column], F.lit(""))) == named["seshat_mark"])
    joined = docs.join(named.hint("shuffle_hash"), on, "left").select(*docs.columns, "seshat_keep")
    text, length = docs.columns.index(text_column), docs.columns.index(length_column) if length_column in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() if k in (text, length) else batch.column(k) for k in range(batch.num_columns - 1)]
            for k, keep in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if keep is not None:
                    columns[text][k] = kept_lines(columns[text][k], keep)
                    if length is not None:
                        columns[length][k] = len(columns[text][k])
            for k in {text, length} - {None}:
                columns[k] = pa.array(columns[k], batch.column(k).type)
            yield pa.record_batch(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)

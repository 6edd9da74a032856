"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bounded-space online best-fit. Pieces arrive one by one; each goes to the open bin with the least
free space that still holds it. Open bins are stacks keyed by free space, and a bitset marks which
stacks are in use, so the tightest bin is the lowest set bit at or above the piece's length. At most
``open_bins`` bins are open; when a new one is needed beyond that, the fullest closes first.

Only (id, piece, length) rows are shuffled, never token ids. Each packing task holds ``open_bins``
bins and nothing else, whatever its input; bins never span tasks, so the loss against packing in
one task is at most ``open_bins`` partly filled bins for each ``tokens_per_task`` tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Workspace

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Open bins in a bitset keyed by free space; ``place`` gives (bin, offset) of one piece."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.n_open, self.made = 0, 0, 0

    def _push(self, free: int, b: int) -> None:
        if free:  # a full bin closes at once
            self.stacks[free].append(b)
            self.bits |= 1 << free
            self.n_open += 1

    def _pop(self, free: int) -> int:
        b = self.stacks[free].pop()
        if not self.stacks[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            b = self._pop(free)
        else:
            free, b = self.capacity, self.made
            self.made += 1
            if self.n_open >= self.open_bins and length < self.capacity:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        self._push(free - length, b)
        return b, self.capacity - free


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids; the first takes the remainder."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, vocabulary: str | None = None, with_ids: bool = False, remembered: int = bpe.REMEMBERED_BYTES) -> DataFrame:
    """One row per piece of each document: (doc_id, piece, start, length, ids_crc32[, ids]).

    Null text counts as empty (its only id is the end id); a null id stays null; each row is its own
    document, whether its id or text repeats or not; other columns are ignored. A very long text is encoded
    whole, in a task's memory. Ids must be numbers.
    """
    path = vocabulary or bpe.vocabulary_path()
    end = int(bpe.END_ID).to_bytes(4, "little")
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path, remembered)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = enc.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * s : 4 * (s + n)]
                    out.append((doc, k, s, n, zlib.crc32(own)) + ((own,) if with_ids else ()))
            yield _batch(out, with_ids)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def pack(parts: DataFrame, *, length_col: str = "length", capacity: int = 1024, open_bins: int = 2048, tokens_per_task: int = 1 << 24) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to ``capacity``.

    ``parts`` should be cheap to read twice (its lengths are summed to choose the number of tasks).
    Rows are dealt by a hash of the row and sorted by it, so equal copies spread over tasks, a lost
    task gives the same bins when it runs again, and rows arrive in no order of size.
    """
    total = parts.agg(F.sum(length_col)).head()[0] or 0
    tasks = max(1, -(-int(total) // tokens_per_task))
    names = parts.columns
    at = names.index(length_col)
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*names, "sequence_id", "offset"])

    deal = F.xxhash64(*[F.col(c) for c in names])
    keyed = parts.withColumn("__deal", deal).repartition(tasks, "__deal")
    return keyed.sortWithinPartitions("__deal", *names).drop("__deal").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, open_bins: int = 2048, remembered: int = bpe.REMEMBERED_BYTES) -> DataFrame:
    """Pieces of all documents with their places: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    An empty table gives no rows. Ties between equally tight bins go to the one opened or filled last.
    """
    work = Workspace(docs.sparkSession, "pack")
    return pack(work.put(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, remembered=remembered), "pieces"), capacity=capacity, open_bins=open_bins)


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, ids binary), joined on (doc_id, piece).

    ``ids`` is ``pieces(..., with_ids=True)``; a sequence gathers at most ``capacity`` ids. It asks
    for unique document ids.
    """
    rows = placed.select("doc_id", "piece", "sequence_id", "offset", "length").join(ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("__p")).select("sequence_id", "n_tokens", F.expr("aggregate(__p, cast('' as binary), (a, p) -> cast(concat(a, p.ids) as binary))").alias("ids"))

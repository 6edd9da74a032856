"""Token ids in Parquet files, laid out so that a reader fetches only what it asks for.

A file holds documents in ascending id order. Ids sit in a list column with dictionary pages (the
vocabulary fits one), document ids, starts and counts in delta-encoded columns; row groups are kept
small and pages hold few rows, and the page index that the writer adds lets a read by document id
skip pages and a read of counts skip the ids altogether.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"


def part_bounds(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16 << 20, most_parts: int = 50_000) -> tuple[int, np.ndarray]:
    """(parts for rows without an id, ids that cut the others into about equal parts of ``part_bytes`` of text).

    An id with very many rows appears again and again. One pass over lengths and one over ids. At most ``most_parts`` - 1
    numbers come to the driver, whatever the table.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 32
    total, nameless = docs.agg(F.sum(size), F.sum(F.when(F.col(id_col).cast("long").isNull(), size))).head()
    first = min(most_parts, -(-int(nameless or 0) // part_bytes))
    n = min(most_parts, max(1, -(-int((total or 0) - (nameless or 0)) // part_bytes)))
    if n == 1:
        return first, np.empty(0, np.int64)
    shares = F.expr("array(" + ", ".join(f"{k / n!r}D" for k in range(1, n)) + ")")
    got = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, F.lit(max(10_000, 10 * n)))).head()[0]
    return first, np.array(got or [], np.int64)


def write_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = bpe.END_ID, row_group_bytes: int = 16 << 20, page_rows: int = 256, part_bytes: int = 16 << 20) -> None:
    """Encode every document and write the ids under ``path`` in ascending id order.

    Null text is empty (the end id alone); null ids come first, dealt over parts of their own; rows with the same id are ordered by their ids'
    bytes within a file, so repeated rows keep a place each. An id whose rows fill several parts is dealt over them.
    Texts are encoded where they are scanned, and ids travel once. ``part`` numbers the files in id order. A very
    long text is one row, encoded whole; it must fit in a task's memory. Ids must be numbers.
    """
    small_batches(docs.sparkSession)
    vocab = vocabulary or bpe.vocabulary_path()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kind = np.dtype("<u2" if max(bpe.most_id(vocab), end_id or 0) < 1 << 16 else "<u4")  # what ids travel as
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nameless, bounds = part_bounds(rows, part_bytes=part_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = bpe.encoder(vocab), 0
        for batch in batches:
            ids, turn = batch.column(0).fill_null(0).to_numpy(), seen + np.arange(batch.num_rows)
            lo, hi = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
            part = nameless + lo + turn % (hi - lo + 1)
            if batch.column(0).null_count:
                part = np.where(batch.column(0).is_null().to_numpy(zero_copy_only=False), turn % max(nameless, 1), part)
            seen += len(ids)
            raws = [enc.encode(t.as_py() or "") + end for t in batch.column(1)]
            flat = np.frombuffer(b"".join(raws), "<u4").astype(kind)
            ends = np.cumsum([0, *map(len, raws)]) // 4 * kind.itemsize
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(raws), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part.astype(np.int32)), packed], ["doc_id", "part", "raw"])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()  # all texts are encoded by now, and the writer needs the memory
        before = 0
        for batch in batches:
            raw = batch.column(2)
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            n = np.diff(at).astype(np.int64) // kind.itemsize
            starts = before + np.concatenate(([0], np.cumsum(n)))
            before = int(starts[-1])
            flat = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind).astype("<i4") if len(raw) else np.empty(0, "<i4")
            lists = pa.ListArray.from_arrays(pa.array(((at - at[0]) // kind.itemsize).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts[:-1]), pa.array(n), lists], ["doc_id", "part", "start_in_part", "n_tokens", "tokens"])

    encoded = rows.mapInArrow(encode, "doc_id long, part int, raw binary").repartitionById(nameless + len(bounds) + 1, F.col("part"))
    files = encoded.sortWithinPartitions("doc_id", "raw").mapInArrow(lay_out, FILE_SCHEMA)
    writer = files.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", "true")
    for column in ("doc_id", "start_in_part", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as they are: (doc_id, part, start_in_part, n_tokens, tokens)."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def part_bases(files: DataFrame) -> DataFrame:
    """Ids before each file: (part, base). Reads two narrow columns; one row a file reaches the window."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
            at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            view = memoryview(flat)
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path)
    digests = files.mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return digests.join(part_bases(files), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")

"""Removal of passages that repeat across documents, by level-wise doubling.

Lengths double from a base to the full window (13, 25 and 50 words). At each level every surviving full
window names one window of that length inside it, the least by hash, a choice that equal windows make
alike. Those found in one document alone fall out, and with them the full windows that named them; the
others are extended to twice the length. It ends when no candidates survive, or with the full windows
that repeat. Exact copies of a text are one class from the start, so a group of copies costs one
document's windows.

Hashes are polynomials over word hashes, 64 bits on the way (a collision only costs work) and 128 bits
for full windows, which are taken as equal when these are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_hot, release, spare

WINDOW, BASE = 50, 13
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of every window of a word sequence. ``most`` bounds the number of remembered words."""

    def __init__(self, most: int = 250_000):
        from xxhash import xxh64_intdigest

        self.one, self.most = xxh64_intdigest, most
        self.memo: dict[bytes, int] = {}
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def words(self, ws: list[bytes]) -> np.ndarray:
        if len(self.memo) > self.most:
            self.memo.clear()
        memo, one = self.memo, self.one
        try:
            return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            memo.update((w, one(w, 1)) for w in set(ws).difference(memo))
            return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))

    def _powers(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.powers or len(self.powers[0][0]) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            self.powers = []
            for base in _BASES:
                pair = []
                for b in (base, pow(base, -1, 1 << 64)):
                    p = np.full(size, b, np.uint64)
                    p[0] = 1
                    pair.append(np.cumprod(p, dtype=np.uint64))
                self.powers.append(tuple(pair))
        return self.powers

    def windows(self, x: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """The hash of x[i : i + k] for every i."""
        n = len(x)
        up, down = self._powers(n + 1)[which]
        x = _mix(x + np.uint64(which + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * up[:n], dtype=np.uint64, out=sums[1:])
        return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def lengths(window: int, base: int) -> list[int]:
    """The levels: ``window`` halved, rounding up, until it is ``base`` or less."""
    out = [window]
    while out[0] > base:
        out.insert(0, -(-out[0] // 2))
    return out


def chosen(hashes: np.ndarray, span: int) -> np.ndarray:
    """For every full window, the start of its least window of a level; the first of equals."""
    return np.arange(len(hashes) - span + 1) + sliding_window_view(hashes, span).argmin(axis=1)


def _words(text) -> list[bytes]:
    raw = text.as_py()
    return raw.split() if raw else []  # bytes split at the six ASCII white spaces only


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(kind)))


def repeats(docs: DataFrame, work: Workspace, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE) -> DataFrame:
    """(doc_id, tag, starts, copy): the windows of each text that also start in a document with a smaller id.

    ``tag`` tells texts under one id apart. ``starts`` is null and ``copy`` true where the whole text is an exact
    copy of one under a smaller id. Rows with a null id take no part. The table is written and small.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    levels = lengths(window, min(base, window - 1))  # the full window is never the base: it takes both hashes
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = rows.select("doc_id", F.hash("text").alias("tag"), F.col("text").cast("binary").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, length = Hasher(), levels[0]
        for batch in batches:
            at, got = [], []
            for text in batch.column(3):
                ws = _words(text)
                p, g = np.empty(0, np.int64), np.empty(0, np.uint64)
                if len(ws) >= window:
                    g = h.windows(h.words(ws), length)
                    p = np.unique(chosen(g, window - length + 1))
                    g = g[p]
                at.append(p)
                got.append(g.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(at, np.int32), _lists(got, np.int64)], ["doc_id", "tag", "content", "at", "h"])

    def extend(before: int, length: int):
        """The windows of ``length`` named by full windows whose window of the level before is known to repeat."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = Hasher()
            for batch in batches:
                for doc, tag, text, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    ws = _words(text)
                    if len(ws) < window:
                        continue
                    x = h.words(ws)
                    named = chosen(h.windows(x, before), window - before + 1)
                    s = np.flatnonzero(np.isin(named, known.values.to_numpy()))
                    if not len(s):
                        continue
                    a = h.windows(x, length)
                    s = np.unique(chosen(a, window - length + 1)[s])
                    b = h.windows(x, length, 1)[s] if length == window else np.zeros(len(s), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(a[s].view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), tag, np.int32)), pa.array(s.astype(np.int32))], ["a", "b", "doc_id", "tag", "at"])

        return run

    content = F.unhex(F.md5("text")).alias("content")
    whole = work.put(rows.select("doc_id", "tag", content, "text").mapInArrow(anchors, "doc_id long, tag int, content binary, at array<int>, h array<long>").where(F.size("at") > 0), "anchors")
    classes = work.put(whole.groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    n_whole = whole.count()
    firsts = join_hot(whole, classes, ["content"], n_whole).where("doc_id = first")
    level = firsts.select("doc_id", "tag", F.explode(F.arrays_zip("at", "h")).alias("z")).select(F.col("z.h").alias("a"), F.lit(0).cast("long").alias("b"), "doc_id", "tag", "z.at")
    level = work.put(level, "level0")
    crowded = work.put(whole.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > F.lit(max(n_whole * 1e-4, 1000.0))), "crowded")
    for k, length in enumerate(levels):
        again = level.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
        again = work.put(again, f"again{k}")
        if length == window:
            break
        known = join_hot(level.drop("tag"), again, ["a", "b"], level.count()).groupBy("doc_id").agg(F.collect_set("at").alias("known"))
        known = work.put(known.join(F.broadcast(crowded), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(1))), f"known{k}")
        work.drop(f"level{k}", f"again{k}")
        release(docs.sparkSession)
        if not known.limit(1).count():  # no candidates survive
            break
        # merged at every size, so that what travels grows with the input
        near = join_hot(rows, known.hint("merge"), ["doc_id"], n_whole).select("doc_id", "tag", "text", "known")
        level = work.put(near.mapInArrow(extend(length, levels[k + 1]), "a long, b long, doc_id long, tag int, at int"), f"level{k + 1}")
        work.drop(f"known{k}")
        release(docs.sparkSession)
    if length == window:
        later = join_hot(level, again, ["a", "b"], level.count()).where("doc_id > lo")
        marked = work.put(later.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("starts")), "marked")
        work.drop(f"level{len(levels) - 1}", f"again{len(levels) - 1}")
    else:
        marked = docs.sparkSession.createDataFrame([], "doc_id long, tag int, starts array<int>")
    copies = join_hot(whole.select("doc_id", "tag", "content"), classes.where("n > 1"), ["content"], n_whole).where("doc_id > first").select("doc_id", "tag").distinct()
    copies = work.put(copies, "copies")
    # a copy may share its id with a text that was extended, and then has windows too
    marked = marked.join(copies, ["doc_id", "tag"], "left_anti")
    copies = copies.withColumn("starts", F.lit(None).cast("array<int>")).withColumn("copy", F.lit(True))
    work.drop("anchors", "classes", "crowded")
    release(docs.sparkSession)
    return marked.withColumn("copy", F.lit(False)).unionByName(copies)


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _left(ws: list[bytes], starts: pa.Scalar, copy: bool | None, window: int) -> list[bytes]:
    """The words that stay."""
    if copy and len(ws) >= window:
        return []
    if not starts.is_valid:
        return ws
    cover = _covered(len(ws), starts.values.to_numpy(), window)
    return [w for w, c in zip(ws, cover.tolist(), strict=True) if not c]


def _with_marks(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` and, behind its columns, the starts and copy marks from ``found``, whose rows are unique by id and tag."""
    d, t, starts, copy = spare(docs, "__d", "__t", "__starts", "__copy")
    right = found.select(F.col("doc_id").alias(d), F.col("tag").alias(t), F.col("starts").alias(starts), F.col("copy").alias(copy))
    same = (F.col(f"`{id_col}`").cast("long") == F.col(d)) & (F.hash(F.col(f"`{text_col}`").cast("string")) == F.col(t))
    return docs.join(right, same, "left").drop(d, t)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    A word goes if a window of ``window`` consecutive words covers it whose words also start in a
    document with a smaller id; all windows are judged on the input. Null and blank texts have no
    words. Rows with a null id lose nothing and count as no one's earlier copy; rows with the same
    id are not earlier than each other. Repeated rows each give a row, an empty table none; other
    columns are ignored. A very long text is one row, read whole; it must fit in a task's memory. Ids must
    be numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = repeats(rows, Workspace(docs.sparkSession, "substring"), window=window, base=base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for text, starts, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                ws = _words(text)
                left = _left(ws, starts, copy, window)
                n.append(len(ws))
                gone.append(len(ws) - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = _with_marks(rows, found, "doc_id", "text").select("doc_id", F.col("text").cast("binary"), "__starts", "__copy")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that ``remove_repeats`` removes, in all its columns.

    A text that loses words becomes the kept words joined by single spaces, and ``size_col`` its length in
    characters; others stay as they are. A document that loses all its words goes.
    """
    found = repeats(docs, Workspace(docs.sparkSession, "substring"), id_col=id_col, text_col=text_col, window=window)
    names = docs.columns
    at, size_at = names.index(text_col), names.index(size_col) if size_col else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, sizes = [], [], []
            for text, starts, copy in zip(batch.column(at), batch.column(len(names)), batch.column(len(names) + 1).to_pylist(), strict=True):
                own, size = text.as_py(), None
                if copy or starts.is_valid:
                    ws = own.encode().split()
                    left = _left(ws, starts, copy, window)
                    if len(left) < len(ws):
                        own = b" ".join(left).decode()
                        size = len(own)
                texts.append(own)
                sizes.append(size)
                keep.append(size != 0)
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, cols[at].type)
            if size_at >= 0:
                cols[size_at] = pa.array([old if new is None else new for old, new in zip(cols[size_at].to_pylist(), sizes, strict=True)], cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    return _with_marks(docs, found, id_col, text_col).mapInArrow(run, docs.schema)

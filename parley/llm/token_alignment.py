"""Alignment of two tokenizers' tokens over the same bytes, by a sweep over token ends.

Every token of A and of B ends at a byte of its text. The ends of both are events of one table, dealt by document and
sorted by offset within a task; a machine reads them once. Where both sides end, a group closes and the two tokens
that end there are linked. Between batches the machine holds the tokens of the open group and running counts, no text.

Events travel packed: one row holds one side's ids of one window of a document's bytes, and since a token's length
follows from its id, the ids tell where each ends. Links are then counted by id pair over all documents.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Workspace, join_hot, small_batches

VOCABULARY_B = "piece_bpe_32k.model"
WINDOW = 1 << 16
#: Pairs of ids that are broadcast at most; more are met by a shuffle.
MOST_BROADCAST = 1_000_000
REMEMBERED = 96 << 20
_CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")

EVENTS = "row long, doc_id long, at int, side byte, ids binary"
SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"


class _PlainEncoder(bpe.MemoEncoder):
    """A's ids with the strings of special tokens as plain text."""

    def __init__(self, path: str, most_bytes: int):
        super().__init__(path, most_bytes)
        self.tok.encode_special_tokens = True
        self.added, self.bends, self.at_added = {}, False, None


class Pair:
    """Both tokenizers and the bytes of their tokens: ``encode`` gives (A's ids, B's ids) of a text, as uint32.

    Neither lets a token run from a character into a space that follows it, so texts are cut before single spaces
    and the parts remembered; a B whose vocabulary has such a piece is called on whole texts.
    """

    def __init__(self, a_path: str, b_path: str, most_bytes: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor

        self.a = _PlainEncoder(a_path, most_bytes)
        shown = {c: b for b, c in bpe._SHOWN.items()}
        entries = self.a.tok.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.a.tok.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for piece, i in entries.items():
            self.bytes_a[i] = piece.encode() if piece in special else bytes(map(shown.__getitem__, piece))
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if own else p.replace("▁", " ").encode() for p, own in pieces]
        self.cuts = not any("▁" in p.lstrip("▁") for p, own in pieces if not own)
        self.memo = bpe._Memo(lambda p: array("I", self.b.encode(p)).tobytes())
        self.most = most_bytes

    def _ids_b(self, parts: list[str]) -> bytes:
        if self.memo.held > self.most:
            self.memo.clear()
            self.memo.held = 0
        return b"".join(map(self.memo.__getitem__, parts))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """None if the text is empty or either side's bytes aren't a space and the text."""
        if not text:
            return None
        if text[0].isspace() or not self.cuts:
            raw_a = self.a.encode(" " + text)
            raw_b = self._ids_b([text] if not self.cuts else [p[1:] if k == 0 else p for k, p in enumerate(_CUT.split(" " + text))])
        else:
            if self.a.after.held + self.a.alone.held + self.a.tails.held > self.a.most:
                self.a.encode("")  # lets go of what it remembers
            parts = bpe._parts(text)
            raw_a, raw_b = b"".join(map(self.a.after.__getitem__, parts)), self._ids_b(parts)
        a, b = np.frombuffer(raw_a, "<u4"), np.frombuffer(raw_b, "<u4")
        want = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != want or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != want:
            return None
        return a, b


_PAIRS: dict[tuple, Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers for each Python worker."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS.clear()
        bpe.forget()
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def lengths(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every token of A and of B, by id."""
    both = Pair(a_path, b_path, 1 << 20)
    return tuple(np.array([len(x) for x in side], np.int64) for side in (both.bytes_a, both.bytes_b))


def _kind(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def events(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str, b_path: str, sizes: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> DataFrame:
    """(row, doc_id, at, side, ids): the tokens of side 0 (A) and 1 (B) that end in window ``at`` of a document.

    A text without tokens gives one row without ids. ``row`` tells documents apart, whatever their ids.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [_kind(len(s)) for s in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        for batch in batches:
            out: list[tuple] = []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = both.encode(text.as_py() or "")
                if found is None:
                    out.append((row, doc, 0, 0, b""))
                    continue
                for side, ids in enumerate(found):
                    at = (np.cumsum(sizes[side][ids]) - 1) // window
                    bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(ids)]
                    out.extend((row, doc, int(at[s]), side, ids[s:e].astype(kinds[side]).tobytes()) for s, e in zip(bounds, bounds[1:]))
            yield _batch(out, [pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.binary()], ["row", "doc_id", "at", "side", "ids"])

    return rows.mapInArrow(run, EVENTS)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


class _Digits:
    """Ids as decimal text, many at a time."""

    def __init__(self, n: int):
        self.wide = len(str(max(n - 1, 1)))
        self.shown = np.zeros((n, self.wide + 1), np.uint8)
        for i in range(n):
            s = str(i).encode()
            self.shown[i, : len(s)] = np.frombuffer(s, np.uint8)
        self.long = np.array([len(str(i)) for i in range(n)], np.int64)

    def text(self, ids: np.ndarray, marks: np.ndarray) -> bytes:
        """Each id in decimal with its mark after it."""
        cells, at = self.shown[ids], self.long[ids]
        cells[np.arange(len(ids)), at] = marks
        return cells[np.arange(self.wide + 1) <= at[:, None]].tobytes()


class Machine:
    """The sweep over one document: takes windows of ends in order, closes groups where both sides end.

    Its state is the open group's ids, counts, a digest and the links that the caller hasn't taken.
    """

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], digits: _Digits):
        self.sizes, self.digits = sizes, digits
        self.start()

    def start(self) -> None:
        self.open_a = self.open_b = np.empty(0, np.uint32)
        self.n_a = self.n_b = self.n_groups = 0
        self.digest, self.links = hashlib.sha256(), []

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        """The tokens that end in the next window, on both sides."""
        self.n_a += len(a)
        self.n_b += len(b)
        a, b = np.concatenate([self.open_a, a]), np.concatenate([self.open_b, b])
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        if not len(a) or not len(b):
            self.open_a, self.open_b = a, b
            return
        near = np.searchsorted(ends_b, ends_a)
        hit = ends_b[np.minimum(near, len(b) - 1)] == ends_a
        last_a = np.flatnonzero(hit)
        last_b = near[last_a]
        if not len(last_a):
            self.open_a, self.open_b = a, b
            return
        self.links.append((b[last_b].astype(np.int64) << 32) | a[last_a])
        cut_a, cut_b = last_a[-1] + 1, last_b[-1] + 1
        self._write(a[:cut_a], b[:cut_b], last_a, last_b)
        self.n_groups += len(last_a)
        self.open_a, self.open_b = a[cut_a:], b[cut_b:]

    def _write(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Adds closed groups to the digest: each group's A ids, then its B ids."""
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        n = len(a) + len(b)
        ids, marks = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        # before A's token stand the B's of earlier groups, before B's the A's of its own group too
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(sizes_a), sizes_b)
        ids[place_a], ids[place_b] = a, b
        marks[place_a[last_a]], marks[place_b[last_b]] = ord("|"), ord(";")
        if self.n_groups:
            self.digest.update(b";")
        self.digest.update(self.digits.text(ids, marks)[:-1])

    def result(self) -> tuple:
        """(n_a, n_b, n_groups, n_links, sha256 of the groups, links); a document without tokens has no digest."""
        links = np.concatenate(self.links) if self.links else np.empty(0, np.int64)
        return self.n_a, self.n_b, self.n_groups, len(links), self.digest.hexdigest() if self.n_groups else "", links


def sweep(found: DataFrame, *, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document with its groups' digest and ``pairs``, each link as B's id * 2^32 + A's id."""
    kinds = [_kind(len(s)) for s in sizes]
    digits_for = max(map(len, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(sizes, _Digits(digits_for))
        now, doc, at, sides = None, None, None, [np.empty(0, np.uint32)] * 2
        out: list[tuple] = []

        def close() -> None:
            machine.take(*sides)
            out.append((now, doc, *machine.result()))
            machine.start()

        def emit() -> pa.RecordBatch:
            kept = [r[7] for r in out]
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
            plain = _batch([r[:7] for r in out], [pa.int64()] * 6 + [pa.string()], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            out.clear()
            return pa.RecordBatch.from_arrays([*plain.columns, lists], [*plain.schema.names, "pairs"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for row, own, window, side, ids in zip(*columns, strict=True):
                if row != now:
                    if now is not None:
                        close()
                    now, doc, at, sides = row, own, window, [np.empty(0, np.uint32)] * 2
                elif window != at:
                    machine.take(*sides)
                    at, sides = window, [np.empty(0, np.uint32)] * 2
                sides[side] = np.frombuffer(ids, kinds[side]).astype(np.uint32)
            if out:
                yield emit()
        if now is not None:
            close()
        if out:
            yield emit()

    dealt = found.repartition("row").sortWithinPartitions("row", "at", "side")
    return dealt.mapInArrow(run, SWEPT)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, n, best): links of all documents by id pair, and whether no other pair of its B id has more."""
    counts = swept.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("__b")).agg(F.max("n").alias("__most"))
    return counts.join(most, F.shiftright("pair", 32) == F.col("__b")).select("pair", "n", (F.col("n") == F.col("__most")).alias("best"))


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, whether its id or text repeats or not.

    Texts that are null or empty, or that either vocabulary can't give back byte by byte, have no tokens: zeros and an
    empty digest. Null ids stay null; ids must be numbers; other columns are ignored. A very long text is encoded whole
    in one task, then swept window by window. An empty table gives no rows.
    """
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark)
    a_path, b_path = a_path or bpe.vocabulary_path(), b_path or public_tokenizers.path(VOCABULARY_B)
    sizes = lengths(a_path, b_path)
    work = Workspace(spark, "alignment")
    swept = work.put(sweep(events(docs, id_col=id_col, text_col=text_col, a_path=a_path, b_path=b_path, sizes=sizes, window=window), sizes=sizes), "swept")
    counts = work.put(pair_counts(swept), "counts")
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    links = swept.select("row", F.explode("pairs").alias("pair"))
    if different <= MOST_BROADCAST:
        met = links.join(F.broadcast(counts), "pair")
        times = F.lit(1)
    else:  # a document's equal links go as one row
        met = join_hot(links.groupBy("row", "pair").agg(F.count("*").alias("times")), counts.withColumn("held", F.col("n")), ["pair"], total, n_col="held")
        times = F.col("times")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * times).alias("count_sum"))
    rows = swept.drop("pairs").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

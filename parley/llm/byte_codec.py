"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts above this many characters are cut at safe boundaries, so no call sees a text much longer.
LONG = 1 << 16

_SPACE = re.compile(r"(?<=\S)(?=\s)")  # the split pattern never goes from a non-space into white space
_SPACES = re.compile(r"\s{4096,}")


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """``encode`` gives uint32 ids of a whole text; ``decode`` gives raw bytes, valid UTF-8 or not."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.enc = tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        table = [b""] * size
        for raw, i in ranks.items():
            table[i] = raw
        self.lengths = np.fromiter(map(len, table), np.int64, size)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.blob = np.frombuffer(b"".join(table), np.uint8)

    def chunks(self, text: str, most: int = LONG) -> Iterator[str]:
        """The text in pieces of about ``most`` characters that tokenize as the whole does.

        Cuts fall before white space that follows a non-space. A run of white space is never cut:
        the pattern's lookahead needs the character after it. A text without a cut comes whole.
        """
        at = 0
        while len(text) - at > most:
            m = _SPACE.search(text, at + most)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        # white space by the thousand is merged as one piece: the library's backtracking has a limit there
        got = [self._run(c) if _SPACES.search(c) else self.enc.encode_to_numpy(c, disallowed_special=()) for c in self.chunks(text)]
        return got[0] if len(got) == 1 else np.concatenate(got)

    def _run(self, text: str) -> np.ndarray:
        """Long runs of white space: all but the last character are one match when more text follows."""
        out, at = [], 0
        for m in _SPACES.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out.append(self.enc.encode_to_numpy(text[at : m.start()], disallowed_special=()))
            out.append(np.asarray(self.enc._encode_single_piece(text[m.start() : end]), np.uint32))
            at = end
        out.append(self.enc.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' byte strings, one after another, by one gather from the table of all bytes."""
        n = self.lengths[ids]
        if not n.size:
            return b""
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])
        return self.blob[at].tobytes()


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, keep_ids: bool = False, keep_bytes: bool = False) -> DataFrame:
    """Per row: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]). No shuffle.

    Null text is empty: no ids, both digests of nothing. A null id stays null. Repeated rows each
    give a row, an empty table none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    import public_tokenizers

    path, pat = ranks or ranks_path(), pattern or public_tokenizers.PATTERN
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded binary" * keep_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for batch in batches:
            ns, a, b, kept, raws = [], [], [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                raw = c.decode(ids)
                ns.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
                if keep_bytes:
                    raws.append(raw)
            cols = [batch.column(0), pa.array(ns, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            if keep_bytes:
                cols.append(pa.array(raws, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)

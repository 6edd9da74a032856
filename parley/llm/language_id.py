"""Language identification by compression.

Each language has a zstandard dictionary of raw text. A text is compressed once with each, in blocks
of fixed length so that a long text cannot become its own dictionary, and gets the language with the
fewest bytes. The score rises with the lead over the runner-up in bytes; a narrow lead is rejected by filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, small_batches, unit_hash

FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-case runs of letters, joined by single spaces; empty if the text has no letter."""
    found = _WORDS.findall(text.lower()) if text else []
    return " ".join(found).encode() if any(c.isalpha() for w in found for c in w) else b""


@dataclass
class Model:
    """Languages, most frequent first (ties go to the earlier), and their dictionaries.

    ``narrow`` is the least lead of the best language, in bytes by the square root of its compressed size, that a
    filter accepts: between languages that explain a text equally well the lead varies like that root, while in
    a text's own language it grows with the size.
    """

    languages: list[str]
    dictionaries: list[bytes]
    level: int = 9
    block: int = 4096
    bytes_a_step: float = 4.0
    narrow: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    @cached_property
    def compressors(self) -> list:
        import zstandard as z

        made = []
        for raw in self.dictionaries:
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            made.append(z.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def sizes(self, raw: bytes) -> np.ndarray:
        parts = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors], np.float64)

    def predict(self, text: str | None) -> tuple[str, float, float, int]:
        """(language, score, margin, bytes compared); the margin is the lead by the square root of the best size."""
        raw = letters(text)
        if not raw or not self.languages:
            return UNKNOWN, 0.0, 0.0, len(raw)
        if len(self.languages) == 1:
            return self.languages[0], 1.0, float("inf"), len(raw)
        s = self.sizes(raw)
        best = int(s.argmin())
        share = np.exp(-(s - s[best]) / self.bytes_a_step)
        return self.languages[best], float(1 / share.sum()), lead(s, best), len(raw)


def lead(sizes: np.ndarray, best: int) -> float:
    return float((np.delete(sizes, best).min() - sizes[best]) / np.sqrt(sizes[best]))


def calibrate(model: Model, known: list[tuple[str, str]], lost: float) -> float:
    """The margin that all but the share ``lost`` of these (language, text) reach, of those that the model reads as their language."""
    if len(model.languages) < 2:
        return 0.0
    own = {x: k for k, x in enumerate(model.languages)}
    got = [lead(s, int(s.argmin())) for x, text in known if (raw := letters(text)) for s in [model.sizes(raw)] if int(s.argmin()) == own.get(x)]
    return max(0.0, float(np.quantile(got, lost))) if got else 0.0


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held_out: int = HELD_OUT, documents: int = 256, most_documents: int = 16_384, part_chars: int = 1024, level: int = 9, lost: float = 0.003) -> Model:
    """Dictionaries from about ``documents`` unlike labelled texts a language, a part of ``part_chars`` characters of each.

    Only rows outside the held-out fold with a language and a text are read. Texts are drawn by a hash of themselves
    below a cut that the language's number of unlike texts sets and that is never below its least hash, so copies
    don't count, no language is lost, however rare, and no task ranks one. All languages' dictionaries together take about
    ``most_documents``, one each at least. A long text's part begins at a place its hash gives. About twice as many
    more texts (a fifth of them where there are few) calibrate the margin: the share ``lost`` of these falls below it.
    Languages are ordered by how many rows they have.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = rows.where((crc_bucket("doc_id", folds) != held_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    train = train.select("lang", "text", unit_hash("text").alias("u"))
    found = train.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("u", 0.02).alias("unlike"), F.min("u").alias("least")).collect()
    if not found:
        return Model([], [], level)
    share = max(1, min(documents, most_documents // len(found)))
    cut = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], max(r["least"], 3.0 * share / max(r["unlike"], 1)))])
    size = F.length("text")
    begin = (F.pmod(F.xxhash64(F.lit(7), "text"), F.greatest(size - part_chars + 1, F.lit(1))) + 1).cast("int")
    drawn = train.where(F.col("u") <= cut[F.col("lang")]).dropDuplicates(["lang", "u"])
    parts: dict[str, list[str]] = {}
    for lang, _, part in drawn.select("lang", "u", F.substring("text", begin, F.lit(part_chars)).alias("part")).orderBy("lang", "u", "part").collect():
        parts.setdefault(lang, []).append(part)
    counts = {r["lang"]: r["n"] for r in found}
    order = sorted(parts, key=lambda x: (-counts[x], x))
    kept = {x: parts[x][: max(1, min(share, len(parts[x]) * 4 // 5))] for x in order}
    model = Model(order, [b" ".join(map(letters, kept[x])) for x in order], level)
    model.narrow = calibrate(model, [(x, p) for x in order for p in parts[x][len(kept[x]) :]], lost)
    return model


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, n_letters) for every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score and margin 0, as is everything when
    nothing was learned. A null id counts as held out: nothing is learned from it. Repeated rows each
    give a row, an empty table none; other columns are ignored. A very long text is compressed whole, in
    blocks of ``model.block`` bytes. Ids must be numbers.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(2)]
            lang, score, margin, size = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(size, pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "margin", "n_letters"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(crc_bucket("doc_id", folds) == held_out, F.lit(True))
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double, n_letters long")


def keeps(found: tuple[str, float, float, int], narrow: float) -> bool:
    """Whether a filter keeps a text: it has a language, with a lead, and that isn't narrow."""
    lang, _, margin, _ = found
    return lang != UNKNOWN and margin > 0 and margin >= narrow


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text ``keeps`` accepts. No shuffle.

    A model that learned nothing, for want of a labelled text, rejects nothing: all rows stay. With one language known, the
    texts with a letter stay. Null texts, and those without a letter, go in all other cases.
    """
    if not model.languages:
        return docs
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([keeps(model.predict(t.as_py()), model.narrow) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

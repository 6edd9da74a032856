"""Corpus and result files, and WAV blobs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from ..operators.results import audio_path
from ..schemas import PREDICTION, SAMPLE


def read_corpus(spark: SparkSession, path: str, audio: bool = False) -> DataFrame:
    """The source corpus; blobs are read only on request."""
    df = spark.read.parquet(path)
    return df if audio or "audio" not in df.columns else df.drop("audio")


def read_samples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A metadata file (an array of objects, or a row a line): typed, unknown fields left out, overlap 0 where missing, path resolved."""
    df = spark.read.schema(SAMPLE).option("multiLine", multi_line).json(path)
    return df.withColumn("overlap_ratio", F.coalesce("overlap_ratio", F.lit(0.0))).withColumn("audio_path", audio_path(F.col("audio_path"), F.col("audio_file"), F.col("sample_id")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Result files of any runner, in the one schema that holds them all."""
    return spark.read.schema(PREDICTION).option("multiLine", True).json(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII unescaped, replacing what was there."""
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """The one row of a nested summary as one JSON document, nulls kept, replacing what was there."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def missing_audio(samples: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Samples whose file is not under ``root``; only the listing is read, not the content."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("__f"))
    return samples.withColumn("__name", F.element_at(F.split("audio_path", "/"), -1)).join(there, F.col("__name") == F.col("__f"), "left_anti").drop("__name")


_HEADER = StructType().add("channels", IntegerType()).add("rate", IntegerType()).add("bits", IntegerType()).add("frames", LongType()).add("ok", BooleanType())

# What a clip must be.
CHANNELS, RATE, BITS = 1, 16_000, 16
#: Bytes before the samples in what ``wav_bytes`` makes.
HEAD = 44


def wav_bytes(pcm: bytes, rate: int = RATE, channels: int = CHANNELS, bits: int = BITS) -> bytes:
    block = channels * bits // 8
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * block, block, bits, b"data", len(pcm))
    return head + pcm


def wav_header(raw: bytes) -> tuple[int, int, int, int] | None:
    """(channels, rate, bits, frames), or None if this is no PCM WAV."""
    if raw is None or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(raw):
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
        if name == b"data" and form:
            return form[1], form[2], form[5], size // max(1, form[4])
        at += 8 + size + size % 2
    return None


@F.pandas_udf(_HEADER)
def check_wav(raw: pd.Series) -> pd.DataFrame:
    """The header of each blob and whether it is mono, 16 kHz, 16 bits."""
    got = [wav_header(bytes(x)) if x is not None else None for x in raw]
    return pd.DataFrame([(*h, h[:3] == (CHANNELS, RATE, BITS)) if h else (None, None, None, None, False) for h in got], columns=["channels", "rate", "bits", "frames", "ok"])


def write_wavs(df: DataFrame, folder: str, key: str = "sample_id", blob: str = "audio") -> DataFrame:
    """Writes one file a row into a folder that executors share and returns (key, path, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            out = []
            for k, raw in pdf.itertuples(index=False):
                path = os.path.join(folder, f"{k}.wav")
                with open(path + ".part", "wb") as f:  # a repeated task replaces the file whole
                    f.write(raw)
                os.replace(path + ".part", path)
                out.append((k, path, len(raw)))
            yield pd.DataFrame(out, columns=[key, "path", "bytes"])

    return df.select(key, blob).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, path string, bytes long")

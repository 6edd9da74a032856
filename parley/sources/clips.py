"""Spoken clips kept under the hash of what they are made from, so each is rendered once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import is_missing
from ..operators.synth import cache_key, hash_text, trim, voice
from .files import RATE, wav_bytes

CLIPS = "key string, audio binary, frames long"
#: Bytes of audio that a task holds before it hands them on: a batch of texts becomes thousands of times its size.
MOST_BYTES = 8 << 20
#: Clips are some eighty times as large as their texts. A file's dictionary keeps equal audio once, up to so many bytes of unlike audio
#: (Parquet's own bound, 1 MB, is some forty clips); where audio rarely repeats, Parquet drops the dictionary.
LOSSLESS = {"compression": "zstd", "parquet.dictionary.page.size": str(64 << 20)}


def spoken(speaker: str, text: str) -> np.ndarray:
    """A stand-in for speech: a tone of ten milliseconds a word, whose pitch depends on the speaker."""
    return voice(0.01 * len(text.split()), hash_text(speaker))


class ClipStore:
    """WAV clips in Parquet under ``root``, by key.

    ``add`` renders what is wanted and not there: an anti join on keys alone, so a second run renders nothing and moves no text,
    and one that broke off leaves whole clips that count. Silence goes from both ends and the level is set before a clip is kept.
    Two writers may render the same clip; readers see it once, since equal keys mean equal clips.
    """

    def __init__(self, spark: SparkSession, root: str, settings: str = "1.0"):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings

    def keyed(self, wanted: DataFrame) -> DataFrame:
        """(key, speaker, text): the hash of speaker, settings and text for every row; nulls are not spoken."""
        rows = wanted.where("speaker is not null and text is not null")
        return rows.select(cache_key(F.col("speaker"), F.lit(self.settings), F.col("text")).alias("key"), "speaker", "text")

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(CLIPS).parquet(f"{self.root}/*")
        except AnalysisException as e:
            if not is_missing(e):
                raise
            return self.spark.createDataFrame([], CLIPS)

    def read(self, *columns: Column | str) -> DataFrame:
        """(key, audio, frames), a row a key; or the key and ``columns`` of these.

        Equal keys meet in a shuffle, and ``columns`` are made before it: without the audio among them, none is moved, nor held in
        the queue before a Python function that takes these columns afterwards.
        """
        return self._stored().select("key", *(columns or ("audio", "frames"))).dropDuplicates(["key"])

    def missing(self, wanted: DataFrame) -> DataFrame:
        """(key, speaker, text) of what is wanted and not there, each key once."""
        return self.keyed(wanted).dropDuplicates(["key"]).join(self._stored().select("key"), "key", "left_anti")

    def has(self, wanted: DataFrame) -> bool:
        """Whether every clip is there; only keys are moved to tell."""
        return self.keyed(wanted).select("key").distinct().join(self._stored().select("key"), "key", "left_anti").isEmpty()

    def add(self, wanted: DataFrame, speak: Callable[[str, str], np.ndarray] = spoken) -> int:
        """How many clips were rendered."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                kept, held = [], 0
                for key, s, t in pdf[["key", "speaker", "text"]].itertuples(index=False):
                    clip = np.clip(trim(speak(s, t)) * 32767, -32768, 32767).astype("<i2").tobytes()
                    kept.append((key, wav_bytes(clip, RATE), len(clip) // 2))
                    held += len(clip)
                    if held >= MOST_BYTES:
                        yield pd.DataFrame(kept, columns=["key", "audio", "frames"])
                        kept, held = [], 0
                if kept:
                    yield pd.DataFrame(kept, columns=["key", "audio", "frames"])

        if self.has(wanted):
            return 0
        path = f"{self.root}/{uuid.uuid4().hex}"
        self.missing(wanted).mapInPandas(run, CLIPS).write.options(**LOSSLESS).parquet(path)
        return self.spark.read.schema(CLIPS).parquet(path).count()

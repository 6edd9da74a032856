"""Normalization of Indic and code-mixed text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ZERO_WIDTH = "​‌‍‎‏﻿"
TAGS = r"(?s)\[.*?\]|<.*?>"
GLOSSES = r"(?s)\(.*?\)"
NOT_KEPT = r"[^\p{L}\p{M}\p{N}\p{Z}]"
SPACE = r"[\s\p{Z}]+"
#: Below U+0300 every character is composed and stays as it is.
MAY_COMPOSE = r"[^\x{0}-\x{2FF}]"


def composed(text: Column) -> Column:
    """Canonical composition (NFC), in the JVM: the static method of the Unicode library that Spark's collations ship with.

    Texts that composition cannot change skip the call. The column counts as non-deterministic, as calls to methods do, so it
    belongs into a projection, not into a join's condition or a group's key.
    """
    call = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(MAY_COMPOSE), call).otherwise(text)


def compose(df: DataFrame, column: str) -> DataFrame:
    """``composed`` in place."""
    return df.withColumn(column, composed(F.col(column)))


def strip_tags(text: Column) -> Column:
    """Bracketed and angle-bracketed marks become a space; an unclosed one stays."""
    return F.regexp_replace(text, TAGS, " ")


def strip_glosses(text: Column) -> Column:
    return F.regexp_replace(text, GLOSSES, " ")


def drop_zero_width(text: Column) -> Column:
    """Deleted without a space, so the parts of a word join."""
    return F.translate(text, ZERO_WIDTH, "")


def keep_word_characters(text: Column) -> Column:
    """Letters, marks, numbers and separators stay; punctuation, symbols and controls become spaces."""
    return F.regexp_replace(text, NOT_KEPT, " ")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column, remove_glosses: bool = True) -> Column:
    """All steps in order, composition first; null gives the empty string."""
    t = strip_tags(F.coalesce(composed(text), F.lit("")))
    if remove_glosses:
        t = strip_glosses(t)
    return collapse_space(keep_word_characters(F.lower(drop_zero_width(t))))


def words(text: Column) -> Column:
    """Words of a normalized text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def normalize_turns(turns: DataFrame, remove_glosses: bool = True, text: str = "text") -> DataFrame:
    """Normalized turns; a turn left without text is dropped."""
    return turns.withColumn(text, normalize(F.col(text), remove_glosses)).where(F.col(text) != "")


def model_slug(model: Column) -> Column:
    """Vendor prefix off, hyphens to underscores; dots stay."""
    return F.translate(F.element_at(F.split(model, "/"), -1), "-", "_")


def canonical_speaker(label: Column) -> Column:
    """The first run of digits names the speaker; a label without one stays."""
    digits = F.regexp_extract(label, r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("Speaker "), digits)).otherwise(F.trim(label))

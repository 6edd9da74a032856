"""Word and character edit distance, and the error rates built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Distinct words that two sides may have together: one supplementary code point stands for each.
ROOM = 1 << 20
#: Diagonals on either side that the first band of ``character_distance`` has to spare.
SLACK = 32


def _spelled(words: Column, vocabulary: Column) -> Column:
    """A string with one character for each word."""

    def char(w: Column) -> Column:
        at = F.array_position(vocabulary, w).cast("int") - 1
        high, low = F.lit(0xD800) + F.shiftright(at, 10), F.lit(0xDC00) + at.bitwiseAND(F.lit(0x3FF))
        return F.decode(F.unhex(F.concat(F.hex(high), F.hex(low))), "UTF-16BE")

    return F.array_join(F.transform(words, char), "")


def word_distance(ref: Column, hyp: Column) -> Column:
    """Unit-cost Levenshtein distance of two word arrays of at most 1,048,576 distinct words between them.

    Words become characters, so the JVM's string distance does the work; equal and empty sides skip it. The
    vocabulary is bound once for a row. A pair with more words is an error, not a wrong distance: ``edit_distance``
    has no such limit.
    """
    room = F.lit(f"more than {ROOM} distinct words in a pair of texts")
    bound = F.transform(F.array(F.array_distinct(F.concat(ref, hyp))), lambda v: F.when(F.size(v) > ROOM, F.raise_error(room).cast("int")).otherwise(F.levenshtein(_spelled(ref, v), _spelled(hyp, v))))
    return F.when(ref == hyp, F.lit(0)).when(F.size(ref) == 0, F.size(hyp)).when(F.size(hyp) == 0, F.size(ref)).otherwise(F.get(bound, F.lit(0)))


def edit_distance(a: list, b: list) -> int:
    """The same for any two sequences, a row at a time in numpy."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    ids = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.fromiter(map(ids.__getitem__, s), np.int64, len(s)) for s in (a, b))
    step = np.arange(len(y) + 1)
    row = step.copy()
    for i, w in enumerate(x):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        # insertions run along the row: a prefix minimum once the step cost is taken out
        row = np.minimum.accumulate(np.concatenate(([i + 1], best)) - step) + step
    return int(row[-1])


def character_distance(a: str | list, b: str | list) -> int:
    """Levenshtein distance of two strings (or two lists), a column of the table at a time as bits of one integer.

    Where one side has all of the other in order, the rest of it is the distance. Else only a band around the diagonals that a distance up to a bound can reach is held, and the bound grows fourfold until
    the distance lies within it, so work grows with the longer side times the distance over the word size; sides that have
    little in common take the whole table.
    """
    if a == b:
        return 0
    b, a = sorted((a, b), key=len)
    rest = iter(a)
    if all(c in rest for c in b):
        return len(a) - len(b)
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    apart, beyond = len(a) - len(b), SLACK
    while apart + 2 * beyond < len(a) // 2:
        distance = _within(where, b, apart, beyond)
        if distance <= apart + 2 * beyond:
            return distance
        beyond *= 4
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = every, 0, len(a)  # rows that step up and down from the row above
    for c in b:
        same = where.get(c, 0)
        level = ((((same & up) + up) ^ up) | same | down) & every
        more, less = down | (every ^ (level | up)), up & level
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (every ^ (level | more)), more & level
    return distance


def _within(where: dict, b: str | list, apart: int, beyond: int) -> int:
    """The distance as far as paths go at most ``beyond`` diagonals past those of the two ends: exact up to ``apart + 2 * beyond``.

    ``where`` has the places of each item of the longer side as bits, ``apart`` is by how much that is longer. Bit t of
    column j is row j - beyond + t, so the band moves down a row a column; rows above the table keep the value of its edge.
    """
    every, end = (1 << (apart + 2 * beyond + 1)) - 1, 1 << (apart + beyond)
    up, down, distance = every >> beyond << beyond, 0, apart
    for at, c in enumerate(b, -beyond):
        same = where.get(c, 0)
        same = (same >> at if at >= 0 else same << -at) & every
        level = ((((same & up) + up) ^ up) | same | down) & every
        distance += not level & end
        more, less = down | (every ^ (level | up)), level & up
        level >>= 1
        up, down = less | (every ^ (level | more)), level & more
    return distance


@F.pandas_udf(IntegerType())
def long_character_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """``character_distance`` of whole transcripts in Arrow batches; the JVM's ``levenshtein`` suits short texts."""
    return pd.Series([None if a is None or b is None else character_distance(a, b) for a, b in zip(ref, hyp, strict=True)], dtype="Int32")


def error_rate(distance: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Both sides empty 0; one side empty 1; else distance over reference length, which may exceed 1."""
    return F.when((n_ref == 0) & (n_hyp == 0), 0.0).when((n_ref == 0) | (n_hyp == 0), 1.0).otherwise(distance / n_ref)


def wer(ref: Column, hyp: Column) -> Column:
    return error_rate(word_distance(ref, hyp), F.size(ref), F.size(hyp))


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate over code points, spaces included."""
    return error_rate(F.when(ref == hyp, 0).otherwise(F.levenshtein(ref, hyp)), F.length(ref), F.length(hyp))


def fold_ascii(text: Column, mark: str = "?") -> Column:
    """Every character beyond ASCII becomes ``mark``."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", mark)

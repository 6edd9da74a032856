"""Comparing the members of bounded groups: hot keys in chunk pairs, groups streamed off a sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_pairs(keyed: DataFrame, hot: DataFrame, *, salt: str, most: int) -> DataFrame:
    """Add (lo, hi, chunk) so that no (key, lo, hi) group holds many more than 2 x ``most`` rows.

    ``hot`` has (key, n) of keys with more than ``most`` rows. Such a key's rows fall into B chunks
    by a hash of ``salt``, and each pair of chunks is a group of its own: every pair of rows still
    meets in exactly one group, a row goes to B groups. Other keys are one group.
    """
    parts = hot.select(F.col("key").alias("__key"), F.ceil(F.col("n") / F.lit(most)).cast("int").alias("__b"))
    joined = keyed.join(parts, keyed.key == F.col("__key"), "left").drop("__key")
    chunk = F.when(F.col("__b").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(7), salt), F.col("__b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("__b", F.lit(1)) - 1))
    dealt = joined.withColumn("chunk", chunk).withColumn("__o", other)
    return dealt.withColumn("lo", F.least("chunk", "__o")).withColumn("hi", F.greatest("chunk", "__o")).drop("__b", "__o")


class UnionFind:
    """Over positions 0..n-1; roots are the smallest positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def spanning(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between positions a and b of ``order`` (node ids), a spanning set (node, root node)."""
    seen, inv = np.unique(np.concatenate([order[a], order[b]]), return_inverse=True)
    uf = UnionFind(len(seen))
    for x, y in zip(inv[: len(a)].tolist(), inv[len(a) :].tolist(), strict=True):
        uf.join(x, y)
    roots = np.fromiter((uf.find(i) for i in range(len(seen))), np.int64, len(seen))
    own = roots != np.arange(len(seen))
    return seen[own], seen[roots[own]]


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], list[pa.Array] | None], out: pa.Schema, flush: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Call ``work`` on each run of equal keys with two rows or more; rows come sorted by the keys."""
    held: pa.Table | None = None
    made: list[list[pa.Array]] = []

    def emit():
        nonlocal made
        rows = [pa.concat_arrays([m[i] for m in made]) for i in range(len(out))]
        made = []
        return pa.RecordBatch.from_arrays(rows, schema=out)

    def runs(table: pa.Table, last: bool) -> pa.Table | None:
        n = table.num_rows
        if not n:
            return None
        edge = np.zeros(n - 1, bool)
        for k in keys:
            v = table[k].to_numpy()
            edge |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), n]
        stop = len(cuts) - 1 if last else len(cuts) - 2
        for i in range(stop):
            if cuts[i + 1] - cuts[i] > 1 and (got := work(table.slice(cuts[i], cuts[i + 1] - cuts[i]))) is not None:
                made.append(got)
        return None if last else table.slice(cuts[stop])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = runs(pa.concat_tables([held, table]).combine_chunks() if held is not None else table, False)
        if sum(len(m[0]) for m in made) >= flush:
            yield emit()
    if held is not None:
        runs(held, True)
    if made:
        yield emit()

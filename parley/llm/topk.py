"""Exact top-k inner products without random access to the lists.

Queries go to the candidates: a block of queries of bounded size is broadcast, and each task reads its own
candidates in blocks, so no candidate is shuffled. A block sorts every dimension of its candidates once. For a
query, a dimension's list is read from the top where the query's component is positive and from the bottom where
it is negative, so contributions come in falling order. After each slice of all lists, a candidate's score lies
between what has been read less, and plus, what its unread dimensions can still add: an unread entry is no better
than the list's next one, and the unread parts together obey the Cauchy-Schwarz inequality. A query stops when
the candidates that can still reach its k-th best lower bound are few; their scores are then resolved exactly. The
bound starts from a sample of candidates scored exactly and rises with every block that a task has finished; a
block whose best possible score is below it is not read at all. Slices of all lists are matrix products with 0/1
masks, so one pass serves a whole block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, unit_hash

_EXACT = float(1 << 53)
#: How far all lists are read before bounds are compared again.
SLICES = (0.6, 1.0)


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors held as int64."""
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[-1]
    if most < _EXACT:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return c @ q


def block_topk(ids: np.ndarray, c: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None, slices: tuple[float, ...] = SLICES, few: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, candidate positions, scores): each query's k best of the block, ties to smaller ids.

    Candidates with the query's own id take no part. ``floor`` has scores that each query's k-th best is known to
    reach; candidates below it may be missing.
    """
    n, d = c.shape
    if not n or not len(q):
        return
    floor = np.full(len(q), -np.inf) if floor is None else floor
    exact = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * d < _EXACT / 4

    def finish(j: int, alive: np.ndarray):
        alive = alive[ids[alive] != q_ids[j]]
        got = _scores(c[alive], q[j])
        best = np.lexsort((ids[alive], -got))[:k]
        return j, alive[best], got[best]

    if n <= 4 * few or not exact:
        for j in range(len(q)):
            yield finish(j, np.arange(n))
        return
    cf = c.astype(np.float64)
    order = np.argsort(-c, axis=0, kind="stable")  # the sorted lists, best first for a positive component
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(cf, order, axis=0)
    square = cf * cf
    top_of_all, low_of_all = lists[0], lists[-1]
    longest = float(np.sqrt(square.sum(1).max()))
    for at in range(0, len(q), 256):
        live = np.arange(at, min(at + 256, len(q)))
        qf = q[live].astype(np.float64)
        # no score of the block is above its lists' heads together, nor above the longest candidate's reach
        best = np.minimum(np.maximum(qf, 0) @ top_of_all + np.minimum(qf, 0) @ low_of_all, np.sqrt((qf * qf).sum(1)) * longest * (1 + 1e-9) + 1)
        reach = best >= floor[live]
        live, qf = live[reach], qf[reach]
        read = np.zeros((n, len(live)))
        before = 0
        for share in slices:
            depth = min(n, max(before + 1, int(n * share)))
            if depth == n or not len(live):
                break
            pos, neg = np.maximum(qf, 0), np.minimum(qf, 0)
            read += (cf * ((rank >= before) & (rank < depth))) @ pos.T + (cf * ((rank < n - before) & (rank >= n - depth))) @ neg.T
            before = depth
            top, low = (rank < depth).astype(np.float64), (rank >= n - depth).astype(np.float64)
            most_pos, most_neg = pos * lists[depth], neg * lists[n - 1 - depth]  # an unread entry is no better than its list's next
            upper = (most_pos + most_neg).sum(1) - top @ most_pos.T - low @ most_neg.T
            is_pos, is_neg = (qf > 0).astype(np.float64), (qf < 0).astype(np.float64)
            rest_c = (square * (1 - top)) @ is_pos.T + (square * (1 - low)) @ is_neg.T
            rest_q = (qf * qf).sum(1) - top @ (pos * pos).T - low @ (neg * neg).T
            bound = np.sqrt(np.maximum(rest_c, 0) * np.maximum(rest_q, 0)) * (1 + 1e-9) + 1
            np.minimum(upper, bound, out=upper)
            upper += read
            lower = read - bound
            lower[ids[:, None] == q_ids[live][None, :]] = -np.inf
            kth = np.maximum(np.partition(lower, n - min(k, n), axis=0)[n - min(k, n)], floor[live])
            can = upper >= kth  # outsiders below cannot qualify; equal bounds may tie
            done = can.sum(0) <= max(few, n // 64)
            for j in np.flatnonzero(done):
                yield finish(int(live[j]), np.flatnonzero(can[:, j]))
            left = ~done
            live, qf, read = live[left], qf[left], read[:, left]
        for at_end in range(0, len(live), 64):  # read to the end: every score is known
            own = live[at_end : at_end + 64]
            got = cf @ q[own].astype(np.float64).T
            for col, j in enumerate(own):
                alive = np.flatnonzero(got[:, col] >= max(floor[j], np.partition(got[:, col], n - min(k + 1, n))[n - min(k + 1, n)]))
                yield finish(int(j), alive)


@dataclass
class Queries:
    """A block of queries of one length: ids, tags, vectors, and scores that their k-th best is known to reach."""

    ids: np.ndarray
    tags: np.ndarray
    v: np.ndarray
    floor: np.ndarray


def _by_length(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, tags, vectors) of the rows (id, tag, v), one matrix for each length."""
    for piece in rows.combine_chunks().to_batches():
        lists = piece.column(2)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(at)
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            yield piece.column(0).to_numpy()[own], piece.column(1).to_numpy()[own], flat[at[own][:, None] + np.arange(d)].reshape(len(own), d)


def _first_bounds(asked: list[Queries], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Raise each query's floor to its k-th best score among a sample of candidates."""
    for block in asked:
        ids, c = sample.get(block.v.shape[1], (np.empty(0, np.int64), None))
        for at in range(0, len(block.ids) if len(ids) > k else 0, 1024):
            q = slice(at, at + 1024)
            got = np.where(ids[:, None] == block.ids[q][None, :], -(1 << 62), _scores(c, block.v[q].T))
            block.floor[q] = np.partition(got, len(ids) - k, axis=0)[len(ids) - k]


def _matches(asked: list[Queries], k: int, candidate_block: int):
    """A task's own k best candidates of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = [block.floor.astype(np.float64) for block in asked]
        best: list[dict[int, list[tuple[int, int]]]] = [{} for _ in asked]

        def take(held: list[pa.RecordBatch]) -> None:
            for ids, _, c in _by_length(pa.Table.from_batches(held)):
                for block, floor, mine in zip(asked, floors, best, strict=True):
                    if block.v.shape[1] != c.shape[1]:
                        continue
                    for j, at, score in block_topk(ids, c, block.ids, block.v, k, floor):
                        found = sorted(mine.get(j, []) + list(zip((-score).tolist(), ids[at].tolist(), strict=True)))[:k]
                        if found:
                            mine[j] = found
                        if len(found) == k:
                            floor[j] = max(floor[j], -found[-1][0])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= candidate_block:
                take(held)
                held, n = [], 0
        if n:
            take(held)
        for block, mine in zip(asked, best, strict=True):
            rows = [(block.ids[j], block.tags[j], i, -s) for j, found in mine.items() for s, i in found if -s >= block.floor[j]]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "tag", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256, candidate_block: int = 8192, query_bytes: int = 32 << 20, sample_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query by integer inner product.

    Components become floor(scale * x). Queries are rows whose id is divisible by ``every``;
    candidates are all rows with another id. Rows with a null id, a null vector, or a null or
    non-finite component take no part; vectors are scored only against vectors of their length.
    Equal scores go to the smaller id. Repeated candidate rows each count; repeated query rows count
    once. A query with fewer than k candidates returns what there is; an empty table gives no rows.
    Scores must fit a long. Other columns are ignored. Ids must be numbers.

    Queries are sent out in blocks of about ``query_bytes``, as a hash deals them, each of which scans the candidates
    once; only each task's k best of a query are shuffled. The first bounds come from about ``sample_rows`` candidates.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    ints = x.where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad).select("id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))
    rows = work.put(ints.select("id", F.xxhash64("v").alias("tag"), "v"), "ints")
    is_query = F.col("id") % every == 0
    n, size = rows.agg(F.count("*"), F.sum(F.when(is_query, 8 * F.size("v") + 32))).head()
    blocks = -(-int(size or 0) // query_bytes)
    asked = work.put(rows.where(is_query).dropDuplicates(["id", "tag"]).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id", "tag"), F.lit(max(1, blocks)))), "asked")
    drawn = rows.where(unit_hash(F.lit(3), "id", "tag") <= min(1.0, sample_rows / max(n, 1))).limit(2 * sample_rows)
    sample = {}
    for ids, _, c in _by_length(drawn.toArrow()):
        sample[c.shape[1]] = (ids, c)
    schema = "query_id long, tag long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = asked.where(F.col("block") == b)
        block = [Queries(i, t, v, np.full(len(i), -(1 << 62))) for i, t, v in _by_length(own.select("id", "tag", "v").toArrow())]
        _first_bounds(block, sample, k)
        got = rows.mapInArrow(_matches(block, k, candidate_block), schema)
        found = found.unionByName(work.put(got, f"found{b}") if blocks > 1 else got)
    best = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """The same in SQL over unique ids: every query against every candidate."""
    return f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * CAST(e AS DOUBLE))) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(CAST(e AS DOUBLE)))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}
    """

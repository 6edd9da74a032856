"""Near-duplicate vectors by lattice hashing.

Each table projects a unit vector to eight random directions and decodes the result to the nearest
point of the E8 lattice, the vector's home cell; the vector also visits the lattice cells nearest to
it beyond its own. Vectors that meet in a cell, one of them at home, are compared by exact cosine.
Equal vectors are one class from the start. A pair may meet in several cells: it counts in the first
one only, which both vectors' cells tell without any exchange, so no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_hot, release
from .components import components
from .grouping import chunk_pairs, spanning, stream_groups


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, and if odd, re-round the worst coordinate."""
    r = np.rint(y)
    e = y - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(e[odd]).argmax(1)
    r[odd, worst] += np.where(e[odd, worst] >= 0, 1, -1)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of the D8 point and the D8 point shifted by one half."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@cache
def shortest() -> np.ndarray:
    """The 240 shortest lattice vectors, which lead to the neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


class Lattice:
    """Cell keys of unit vectors of one length: ``keys[:, t, 0]`` is table t's home, the rest are visits."""

    def __init__(self, dim: int, tables: int, visits: int, scale: float, seed: int = 17):
        self.dim, self.tables, self.visits = dim, tables, visits
        rng = np.random.default_rng([seed, dim])
        self.directions = rng.standard_normal((tables, dim, 8)) * scale
        self.factors = rng.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _key(self, t: int, cell: np.ndarray) -> np.ndarray:
        """A 64-bit key; cells that share one by chance only cause comparisons."""
        twice = np.rint(cell * 2).astype(np.int64).view(np.uint64)
        x = (twice * self.factors).sum(-1, dtype=np.uint64) + np.uint64(t * 1_000_003 + self.dim)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        out = np.empty((len(unit), self.tables, 1 + self.visits), np.uint64)
        for t in range(self.tables):
            y = unit @ self.directions[t]
            home = nearest_e8(y)
            out[:, t, 0] = self._key(t, home)
            if self.visits:
                toward = (y - home) @ shortest().T
                near = toward.argmax(1)[:, None] if self.visits == 1 else np.argsort(-toward, axis=1, kind="stable")[:, : self.visits]
                out[:, t, 1:] = self._key(t, home[:, None, :] + shortest()[near])
        return out


@cache
def lattice(dim: int, tables: int, visits: int, scale: float) -> Lattice:
    return Lattice(dim, tables, visits, scale)


def counts_here(keys: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.uint64) -> np.ndarray:
    """Of pairs that meet in the cell ``here``, those that meet in no earlier one."""
    free = np.ones(len(a), bool)
    mine = np.zeros(len(a), bool)
    for t in range(keys.shape[1]):
        ha, hb = keys[a, t, 0], keys[b, t, 0]
        at_a = (ha == hb) | (keys[b, t, 1:] == ha[:, None]).any(1)  # they meet at a's home
        at_b = (ha == hb) | (keys[a, t, 1:] == hb[:, None]).any(1)
        top = np.uint64((1 << 64) - 1)
        first = np.minimum(np.where(at_a, ha, top), np.where(at_b, hb, top))
        met = at_a | at_b
        mine |= free & met & (first == here)
        free &= ~met
    return mine


def _unit(raws: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


#: Measured on 8,000 random pairs at cosine 0.9 and 100,000 at cosine 0: (scale, visits, tables, share of unlike pairs that
#: meet), each with a recall of 0.95 or more at cosine 0.9 itself. Projections depend on the angle only, so length doesn't matter.
SETTINGS = [(0.4, 1, 3, 0.18), (0.5, 1, 5, 0.047), (0.6, 1, 7, 0.018), (0.7, 2, 7, 0.011), (0.9, 8, 6, 0.005)]


def plan(n: int, min_cosine: float) -> tuple[float, int, int]:
    """(scale, visits, tables) of the least expected cost for ``n`` vectors.

    A shuffled row is taken to cost as much as 1,000 comparisons. Cells grow with the distance at the threshold.
    """
    cost = lambda x: n * x[2] * (1 + x[1]) * 1000 + 0.5 * n * n * x[3]
    scale, visits, tables, _ = min(SETTINGS, key=cost)
    return scale * float(np.sqrt(0.1 / max(1 - min_cosine, 1e-9))), visits, tables


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = 0.9, tables: int | None = None, visits: int | None = None, scale: float | None = None, most_group: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    ``n_links`` counts the other rows found with a cosine of at least ``min_cosine``;
    ``component_id`` is the smallest id reachable by links, itself included; ``kept`` tells whether
    that is the row's own id. Vectors that are null, zero or empty or hold null or non-finite
    components, and rows with a null id, link with nothing and are kept. Vectors of different
    lengths don't link. Repeated rows are rows like any other. Vectors link, not ids: unlike vectors under
    one id have each its own links. An empty table gives no rows; other columns are ignored. Ids must be numbers.

    Cell size, visits and tables follow from the number of unlike vectors by ``plan`` unless given. With each of
    its settings a pair is found with a chance of about 0.95 at ``min_cosine`` itself and more above it.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "lattice")
    single = dict(vectors.select(vector_col).dtypes)[vector_col] == "array<float>"
    kind, item = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    width = np.dtype(kind).itemsize

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = np.asarray(v.values.to_numpy(), kind)
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    rows = work.put(vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast(item)).mapInArrow(ready, "vec_id long, v binary"), "rows")
    usable = rows.where("vec_id is not null and v is not null")
    grouped = usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = work.put(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")  # ids hold once written
    chosen = plan(classes.count(), min_cosine)
    scale, visits, tables = (own if own is not None else ours for own, ours in zip((scale, visits, tables), chosen, strict=True))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(2).to_pylist()
            size = np.array([len(r) for r in raws])
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                keys = lattice(int(s) // width, tables, visits, scale).keys(_unit([raws[i] for i in own], kind))
                part = batch.take(pa.array(own))
                for t in range(tables):
                    for k in range(1 + visits):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[:, t, k].view(np.int64)), pa.array(np.full(len(own), k == 0)), *part.columns], ["key", "home", "node", "n", "v"])

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.select(["key"]) for b in visit(batches))

    keyed = classes.select("node", "n", "v").mapInArrow(visit, "key long, home boolean, node long, n long, v binary")
    sizes = classes.select("node", "n", "v").mapInArrow(bare, "key long").groupBy("key").agg(F.count("*").alias("n"))
    hot = work.put(sizes.where(F.col("n") > most_group), "hot")
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def compare(table: pa.Table) -> list[pa.Array] | None:
        raws = table["v"].to_pylist()
        size = np.array([len(r) for r in raws])
        if (size != size[0]).any():
            return None if len(np.unique(size)) == len(size) else _by_size(table, size)
        home = table["home"].to_numpy()
        if not home.any():
            return None
        unit = _unit(raws, kind)
        chunk, node, n = table["chunk"].to_numpy(), table["node"].to_numpy(), table["n"].to_numpy()
        across = table["lo"][0].as_py() != table["hi"][0].as_py()
        at = np.flatnonzero(home)
        found_a, found_b = [], []
        for i in range(0, len(at), 512):
            r = at[i : i + 512]
            near = unit[r] @ unit.T >= min_cosine
            if across:
                near &= chunk[r, None] != chunk[None, :]
            x, y = np.nonzero(near)
            keep = (node[r[x]] < node[y]) | (~home[y] & (node[r[x]] != node[y]))  # each pair once
            found_a.append(r[x[keep]])
            found_b.append(y[keep])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if not len(a):
            return None
        used, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        keys = lattice(int(size[0]) // width, tables, visits, scale).keys(unit[used])
        once = counts_here(keys, inv[: len(a)], inv[len(a) :], np.int64(table["key"][0].as_py()).astype(np.uint64))
        a, b = a[once], b[once]
        if not len(a):
            return None
        links = np.zeros(len(node), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        got, root = spanning(node, a, b)
        up = dict(zip(got.tolist(), root.tolist(), strict=True))
        own = np.flatnonzero(links)
        ids = node[own]
        return [pa.array(ids), pa.array([up.get(i, i) for i in ids.tolist()], pa.int64()), pa.array(links[own])]

    def _by_size(table: pa.Table, size: np.ndarray) -> list[pa.Array] | None:
        parts = [compare(table.take(pa.array(np.flatnonzero(size == s)))) for s in np.unique(size)]
        parts = [p for p in parts if p is not None]
        return [pa.concat_arrays([p[i] for p in parts]) for i in range(3)] if parts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream_groups(batches, ["key", "lo", "hi"], compare, schema)

    dealt = chunk_pairs(keyed, hot, salt="node", most=most_group).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    met = work.put(dealt.mapInArrow(run, "node long, root long, links long"), "met")
    release(spark)
    roots = work.put(components(met.select("node", "root"), work), "roots")
    linked = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(linked, "node", "left").join(roots, "node", "left")
    named = work.put(named.select("v", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "named")
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    by_class = work.put(join_hot(named, by_root, ["root"], named.count(), n_col="size").select("v", "n", "n_links", "component_id"), "by_class")
    work.drop("hot", "met", "roots", "named", "classes")
    release(spark)
    found = join_hot(usable, by_class, ["v"], usable.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec_id is null or v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

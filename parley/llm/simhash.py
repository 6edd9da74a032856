"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints differ in at most ``most_bits`` bits exactly when, for any partition of the bits into m
groups with thresholds that sum to most_bits - m + 1, some group differs in no more bits than its
threshold (a threshold of -1 leaves the group out). Correlated bits are put in the same group, so
the other groups tell fingerprints apart better, and a dynamic program deals out the thresholds by
the candidates and probes that each is expected to cost. Statistics come from all fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_hot, release
from .components import components
from .grouping import chunk_pairs, spanning, stream_groups

SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 3
MOST_GROUP = 1 << 18
#: Comparisons that a shuffled row costs as much as: narrow rows for fingerprints alone, wide ones with more bits.
PROBE_COST, WIDE_PROBE_COST = 40.0, 1000.0


def sketch(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED, longs: int = 1) -> np.ndarray:
    """64 x ``longs`` majority bits over the hashes of every word shingle; all 0 for no words.

    The first 64 are those of XXH64, the others those of hashes mixed from it. ``bytes.lower`` changes A-Z only, and
    ``bytes.split`` splits at the six ASCII white spaces only.
    """
    from xxhash import xxh64_intdigest as h

    ws = text.lower().split() if text else []
    if not ws:
        return np.zeros(longs, np.uint64)
    n = max(1, len(ws) - words + 1)
    ones = np.zeros(64 * longs, np.int64)
    for at in range(0, n, 1 << 14):
        end = min(n, at + (1 << 14))
        got = np.array([h(b" ".join(ws[i : i + words]), seed) for i in range(at, end)], np.uint64)
        every = np.stack([got, *(_spread(got + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(1, longs))], axis=1)
        ones += np.unpackbits(every.astype("<u8").view(np.uint8).reshape(-1, 8 * longs), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64 bits of ``sketch``."""
    return int(sketch(text, words, seed)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED, also: tuple[str, ...] = (), longs: int = 1) -> DataFrame:
    """(doc_id, fp, x1, ..) for every row: the bit patterns of ``longs`` times 64 bits in longs.

    The long columns ``also`` follow unchanged.
    """
    names = ["doc_id", "fp", *(f"x{k}" for k in range(1, longs)), *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([sketch(t.as_py(), words, seed, longs) for t in batch.column(1)], np.uint64).reshape(-1, longs).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(longs)), *batch.columns[2:]], names)

    schema = ", ".join(f"{c} long" for c in names)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"), *also).mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Fingerprints in all, and the 64 x 64 matrix of how many have both bits set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            bits = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(v), both + bits.T @ bits
        i, j = np.divmod(np.arange(4097), 64)  # the last row carries the count
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["i", "j", "n"])

    got = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for i, j, n in got:
        flat[i * 64 + j] = n
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of even width, each grown around a bit by mean absolute correlation."""
    f = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(f * (1 - f), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(f, f)) / np.outer(sd, sd))
    left, out = list(range(64)), []
    for k in range(m):
        width = (64 - sum(map(len, out))) // (m - k)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            b = max(left, key=lambda b: (corr[b, own].mean(), -b))
            own.append(b)
            left.remove(b)
        out.append(sorted(own))
    return out


def close_share(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Expected share of pairs that differ in at most 0, 1, .. ``most`` of these bits.

    The mean and variance of the distance follow from the bits' counts and joint counts; a
    beta-binomial law with these moments gives the tail.
    """
    n, w = max(n, 1), len(bits)
    p11 = both[np.ix_(bits, bits)] / n
    f = np.diag(p11)
    p10 = f[:, None] - p11
    p01 = f[None, :] - p11
    p00 = 1 - f[:, None] - f[None, :] + p11
    d = 2 * f * (1 - f)
    joint = 2 * (p11 * p00 + p10 * p01)
    np.fill_diagonal(joint, d)
    mean, var = d.sum(), joint.sum() - d.sum() ** 2
    q = min(max(mean / w, 1e-6), 1 - 1e-6)
    rho = min(max((var / max(w * q * (1 - q), 1e-9) - 1) / max(w - 1, 1), 1e-4), 0.9)
    a, b = q * (1 - rho) / rho, (1 - q) * (1 - rho) / rho
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    out, total = [], 0.0
    for k in range(most + 1):
        total += np.exp(np.log(comb(w, k)) + beta(k + a, w - k + b) - beta(a, b)) if k <= w else 0.0
        out.append(min(1.0, float(total)))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1) that sum to ``total`` at the least cost; costs[i][t + 1] is group i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in then or c + x < then[s + t][0]:
                    then[s + t] = (c + x, [*ts, t])
        best = then
    return best[total]


def plan(n: int, both: np.ndarray, most_bits: int = MOST_BITS, probe_cost: float = PROBE_COST) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds of the least expected cost over 2 to most_bits + 3 groups.

    A shuffled row is taken to cost as much as ``probe_cost`` comparisons.
    """
    found = []
    for m in range(2, most_bits + 4):
        groups = group_bits(n, both, m)
        costs = []
        for g in groups:
            share = close_share(n, both, g, most_bits)
            probes = np.cumsum([comb(len(g), k) for k in range(most_bits + 1)])
            costs.append([0.0, *(n * float(probes[t]) * probe_cost + 0.5 * n * n * share[t] * (1 if t == 0 else 2) for t in range(most_bits + 1))])
        cost, ts = allocate(costs, most_bits - m + 1)
        found.append((cost, groups, ts))
    return min(found, key=lambda x: x[0])[1:]


def _masks(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``most`` set, zero first."""
    out = [0]
    for _ in range(most):
        out = list(dict.fromkeys(out + [m | 1 << b for m in out for b in range(width)]))
    return np.array(out, np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of keys; one-to-one, so keys meet only if they are equal."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(fps: DataFrame, groups: list[list[int]], thresholds: list[int], more: tuple[str, ...] = (), narrow: bool = False) -> DataFrame:
    """(key, home, node, fp, more..): each fingerprint at its own key in every used group and at the keys near it.

    ``narrow`` gives the keys alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).to_numpy().view(np.uint64)
            for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
                if t < 0:
                    continue
                own = np.zeros(len(v), np.uint64)
                for k, b in enumerate(bits):
                    own |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
                for k, mask in enumerate(_masks(len(bits), t)):
                    key = pa.array(_spread((own ^ mask) * np.uint64(8) + np.uint64(i) if len(bits) <= 61 else own ^ mask).view(np.int64))
                    if narrow:
                        yield pa.RecordBatch.from_arrays([key], ["key"])
                    else:
                        yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(v), k == 0)), *batch.columns], ["key", "home", "node", "fp", *more])

    return fps.select("node", "fp", *more).mapInArrow(run, "key long" if narrow else "key long, home boolean, node long, fp long" + "".join(f", {c} long" for c in more))


def links(keyed: DataFrame, hot: DataFrame, *, most_bits: int = MOST_BITS, more: tuple[str, ...] = (), most_in_all: int = 0, most_group: int = MOST_GROUP) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints are within ``most_bits``: a spanning set for each group.

    Where there are ``more`` bits, linked nodes must also be within ``most_in_all`` bits of all together. Every pair
    that shares a key is compared, in blocks; a group of g nodes yields at most g - 1 rows. ``hot`` has (key, n) of the
    keys with more than ``most_group`` rows.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> list[pa.Array] | None:
        home, chunk = t["home"].to_numpy(), t["chunk"].to_numpy()
        node, fp = t["node"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        rest = [t[c].to_numpy().view(np.uint64) for c in more]
        across = t["lo"][0].as_py() != t["hi"][0].as_py()
        rows = np.flatnonzero(home)
        found_a, found_b = [], []
        for at, to in product(range(0, len(rows), 256), range(0, len(fp), 1 << 14)):
            r, c = rows[at : at + 256], slice(to, to + (1 << 14))
            apart = np.bitwise_count(fp[r, None] ^ fp[None, c])
            x, y = np.nonzero(apart <= most_bits)
            in_all, x, y = apart[x, y].astype(np.int64), r[x], y + to
            keep = (node[x] != node[y]) & (chunk[x] != chunk[y] if across else True)
            if more:
                for v in rest:
                    in_all += np.bitwise_count(v[x] ^ v[y])
                keep &= in_all <= most_in_all
            found_a.append(x[keep])
            found_b.append(y[keep])
        a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (found_a, found_b))
        if not len(a):
            return None
        got, root = spanning(node, a, b)
        return [pa.array(got), pa.array(root)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream_groups(batches, ["key", "lo", "hi"], compare, schema)

    dealt = chunk_pairs(keyed, hot, salt="node", most=most_group)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def linked(nodes: DataFrame, work: Workspace, most_bits: int = MOST_BITS, more: tuple[str, ...] = (), most_in_all: int = 0, most_group: int = MOST_GROUP, probe_cost: float = PROBE_COST) -> DataFrame:
    """(node, root) of the nodes that link, from a written table (node, fp, more..)."""
    n, both = bit_counts(nodes)
    groups, thresholds = plan(n, both, most_bits, probe_cost)
    sizes = keys(nodes, groups, thresholds, narrow=True).groupBy("key").agg(F.count("*").alias("n"))
    hot = work.put(sizes.where(F.col("n") > most_group), "hot")
    edges = work.put(links(keys(nodes, groups, thresholds, more), hot, most_bits=most_bits, more=more, most_in_all=most_in_all, most_group=most_group), "edges")
    work.drop("hot")
    return work.put(components(edges, work), "roots")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``component_id`` is the smallest id reachable over links of at most ``most_bits`` differing
    bits, a document itself included. Null and wordless texts have the fingerprint zero and link
    like any other. Fingerprints link, not ids: unlike texts under one id may be in different components.
    Rows with a null id link too and never name a component unless all its rows have null ids (then it
    is null). Repeated rows each give a row; an empty table gives none; other columns are ignored. A very
    long text is read once, in blocks of 16,384 shingles. Ids must be numbers.
    """
    work = Workspace(docs.sparkSession, "simhash")
    own = work.put(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "own")
    prints = work.put(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = linked(prints.select(F.col("fp").alias("node"), "fp"), work, most_bits)
    named = work.put(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    comps = work.put(join_hot(named, by_root, ["root"], named.count(), n_col="size").select("fp", "component_id", "n"), "components")
    work.drop("prints", "named", "roots", "edges")
    release(docs.sparkSession)
    found = join_hot(own, comps, ["fp"], own.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

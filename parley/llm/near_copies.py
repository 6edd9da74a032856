"""One row of each group of near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints within three bits meet by op7's generalised pigeonhole (``simhash.linked``). At a similarity of 0.8 they differ
in a sixth of their bits, and a pigeonhole over so many bits compares nearly all pairs. So those farther apart meet by bands
of least hashes of the same shingles as well, work that grows with the rows; SimHash bits then sort out what meets by
chance, and within each loose group that is left the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Workspace, join_hot, release, spare
from .components import components
from .grouping import UnionFind, chunk_pairs, stream_groups

WORDS, SIMILARITY, LONGS = 5, 0.8, 4
#: A pair of similarity 0.8 shares one of the bands at least with a probability of 0.99, of 0.3 with 0.03.
BANDS, ROWS_A_BAND = 12, 5
#: Fingerprints of linked texts may differ in as many bits more than expected as this many standard deviations.
SPREAD = 3.0
#: Rows of one key, and of one loose group, that meet in a task at most; larger ones go out in pairs of chunks.
MOST_GROUP, MOST_SETS = 1 << 13, 1024

_DRAWN = np.random.default_rng(42)
_FACTORS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS_A_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS_A_BAND, dtype=np.uint64)


def shingles(text: bytes | None, words: int = WORDS, seed: int = simhash.SEED) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles in order; a text of fewer words is one shingle, of none has none."""
    from xxhash import xxh64_intdigest as h

    ws = text.lower().split() if text else []
    n = max(1, len(ws) - words + 1) if ws else 0
    return np.unique(np.fromiter((h(b" ".join(ws[i : i + words]), seed) for i in range(n)), np.uint64, n))


def bits(found: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """SimHash of a set of shingle hashes, 64 x ``longs`` majority bits."""
    ones = np.zeros(64 * longs, np.int64)
    for at in range(0, len(found), 1 << 13):
        own = found[at : at + (1 << 13)]
        every = np.stack([own, *(simhash._spread(own + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(1, longs))], axis=1)
        ones += np.unpackbits(every.astype("<u8").view(np.uint8).reshape(-1, 8 * longs), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found), bitorder="little").view("<u8").astype(np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: the least of its hashes over the set, mixed."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 12):
        own = found[at : at + (1 << 12), None] * _FACTORS + _SHIFTS
        least = np.minimum(least, own.min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS_A_BAND).T:
        keys = simhash._spread(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


def most_apart(similarity: float, n_bits: int) -> int:
    """How many of ``n_bits`` bits sets of that similarity differ in, and ``SPREAD`` standard deviations more.

    Their cosine is 2 s / (1 + s) at least, and a bit differs in the share of the angle in pi.
    """
    p = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return int(n_bits * p + SPREAD * sqrt(n_bits * p * (1 - p)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1) if len(a) or len(b) else 1.0


def _described(docs: DataFrame, names: tuple[str, str], *, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """(doc_id, h, g, rid, node, fp, x1.., b0.., set) of every row: the text's class, bits, bands and shingles (32 bits each)."""
    from xxhash import xxh64_intdigest as h

    longs = ["node", "fp", *(f"x{k}" for k in range(1, LONGS)), *(f"b{k}" for k in range(BANDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = [], []
            for text in batch.column(4):
                found = shingles(text.as_py(), words, seed)
                rows.append(np.concatenate([[np.uint64(h(found.tobytes()))], bits(found), bands(found)]))
                sets.append(np.unique((found >> np.uint64(32)).astype("<u4")).tobytes())
            got = np.array(rows, np.uint64).reshape(-1, len(longs)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(longs))), pa.array(sets, pa.binary())], ["doc_id", "h", "g", "rid", *longs, "set"])

    schema = "doc_id long, h long, g long, rid long, " + ", ".join(f"{c} long" for c in longs) + ", set binary"
    return docs.select(F.col(id_col).cast("long"), *names, F.monotonically_increasing_id(), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, schema)


def _merge(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Component labels (least positions) once the pairs x, y are joined as well."""
    while len(x):
        least = np.minimum(labels[x], labels[y])
        np.minimum.at(labels, labels[x], least)
        np.minimum.at(labels, labels[y], least)
        while (labels[labels] != labels).any():
            labels = labels[labels]
        apart = labels[x] != labels[y]
        x, y = x[apart], y[apart]
    return labels


def loose_links(keyed: DataFrame, hot: DataFrame, similarity: float, most_group: int = MOST_GROUP) -> DataFrame:
    """Edges (a, b) between nodes that share a key and whose bits allow the similarity: a spanning set for each group.

    Every pair that shares a key is compared, in blocks; pairs that are connected already are dropped block by block, so a
    group of g nodes takes memory in proportion to g and yields at most g - 1 rows. ``hot`` has (key, n) of the keys with more
    than ``most_group`` rows.
    """
    more = [f"x{k}" for k in range(1, LONGS)]
    first, most = most_apart(similarity, 64), most_apart(similarity, 64 * LONGS)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> list[pa.Array] | None:
        node, chunk = t["node"].to_numpy(), t["chunk"].to_numpy()
        fp, *rest = (t[c].to_numpy().view(np.uint64) for c in ("fp", *more))
        across = t["lo"][0].as_py() != t["hi"][0].as_py()
        labels = np.arange(len(node))
        for at, to in product(range(0, len(node), 256), range(0, len(node), 1 << 12)):
            if to + (1 << 12) <= at:
                continue
            r, c = slice(at, at + 256), slice(to, to + (1 << 12))
            near = (np.bitwise_count(fp[r, None] ^ fp[None, c]) <= first) & (labels[r, None] != labels[None, c])
            if across:
                near &= chunk[r, None] != chunk[None, c]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            x, y = x + at, y + to
            apart = np.bitwise_count(fp[x] ^ fp[y]).astype(np.int32)
            for v in rest:
                apart += np.bitwise_count(v[x] ^ v[y])
            keep = apart <= most
            labels = _merge(labels, x[keep], y[keep])
        own = np.flatnonzero(labels != np.arange(len(node)))
        return [pa.array(node[own]), pa.array(node[labels[own]])] if len(own) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream_groups(batches, ["key", "lo", "hi"], compare, schema)

    dealt = chunk_pairs(keyed, hot, salt="node", most=most_group)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def pigeonhole_links(nodes: DataFrame, work: Workspace) -> DataFrame:
    """Edges (a, b) that connect the nodes whose 64 bits op7's pigeonhole links, directly or over others: a spanning set.

    ``simhash.linked`` meets each fingerprint once, so texts that share one cost it nothing.
    """
    prints = work.put(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "prints")
    roots = simhash.linked(prints.select(F.col("fp").alias("node"), "fp"), work)
    named = work.put(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    by_root = named.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("nodes"), F.count("*").alias("size")).where("nodes > 1")
    classes = work.put(join_hot(named, by_root, ["root"], named.count(), n_col="size").select("fp", "first", "n"), "classes")
    met = join_hot(nodes.select("node", "fp"), classes, ["fp"], nodes.count())
    return met.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))


def verified(members: DataFrame, hot: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between the nodes of each loose group whose shingle sets are as similar as asked; enough to connect all that do.

    ``members`` is (key, node, fp, x1.., set). The closest pairs are looked at first, and a pair that earlier edges connect
    is not looked at again, so a group of g near copies costs about g comparisons of sets.
    """
    more = [f"x{k}" for k in range(1, LONGS)]
    most = most_apart(similarity, 64 * LONGS)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> list[pa.Array] | None:
        node, chunk = t["node"].to_numpy(), t["chunk"].to_numpy()
        prints = [t[c].to_numpy().view(np.uint64) for c in ("fp", *more)]
        sets = [np.frombuffer(x.as_buffer(), "<u4") for x in t["set"].combine_chunks()] if t.num_rows else []
        size = np.array([len(x) for x in sets], np.float64)
        across = t["lo"][0].as_py() != t["hi"][0].as_py()
        met = []
        for at, to in product(range(0, len(node), 256), range(0, len(node), 1 << 12)):
            if to + (1 << 12) <= at:
                continue
            r, c = slice(at, at + 256), slice(to, to + (1 << 12))
            apart = sum(np.bitwise_count(p[r, None] ^ p[None, c]).astype(np.uint16) for p in prints)
            x, y = np.nonzero(apart <= most)
            d, x, y = apart[x, y], x + at, y + to
            keep = (x < y) & (np.minimum(size[x], size[y]) >= (similarity - 1e-3) * np.maximum(size[x], size[y]))
            if across:
                keep &= chunk[x] != chunk[y]
            met.append(np.stack([d[keep], x[keep], y[keep]], axis=1).astype(np.int32))
        rows = np.concatenate(met)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        groups, found = UnionFind(len(node)), []
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            roots = np.fromiter((groups.find(i) for i in range(len(node))), np.int64, len(node))
            for _, x, y in part[roots[part[:, 1]] != roots[part[:, 2]]].tolist():
                if groups.find(x) != groups.find(y) and jaccard(sets[x], sets[y]) >= similarity:
                    groups.join(x, y)
                    found.append((x, y))
        if not found:
            return None
        a, b = np.array(found).T
        return [pa.array(node[a]), pa.array(node[b])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream_groups(batches, ["key", "lo", "hi"], compare, schema)

    dealt = chunk_pairs(members, hot, salt="node", most=MOST_SETS)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, seed: int = simhash.SEED) -> DataFrame:
    """The rows of ``docs`` but for near copies: one row of each component of linked texts, in all its columns.

    Texts link at a Jaccard similarity of ``similarity`` or more over their distinct shingles of ``words`` words, A-Z
    lower-cased; none below it do, up to chance matches of 32-bit hashes. A pair at 0.8 itself is found with a
    probability of about 0.99. The row that stays is the one with the smallest id, a null id coming last; rows that share
    an id are decided by a hash of all columns. Texts link, not ids: unlike texts under one id, or under none, stay. All
    texts without words are one group. Repeated rows are copies; an empty table gives none. Columns of any type and name
    may follow. A very long text is read once, whole. Ids must be numbers.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near_copies")
    one, two = spare(docs, "row_hash", "row_hash_again")
    plain = lambda c, t: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`")  # noqa: E731  maps have no hash
    whole = [x for c, t in docs.dtypes for x in (F.col(f"`{c}`").isNull(), plain(c, t))]  # the hash skips nulls
    marked = docs.withColumns({one: F.xxhash64(*whole), two: F.xxhash64(F.lit(1), *whole)})
    prints = ("fp", *(f"x{k}" for k in range(1, LONGS)))
    own = work.put(_described(marked, (one, two), id_col=id_col, text_col=text_col, words=words, seed=seed), "own")
    keys = [f"b{k}" for k in range(BANDS)]
    nodes = work.put(own.groupBy("node").agg(*[F.first(c).alias(c) for c in (*prints, *keys)], F.min("rid").alias("rid")), "nodes")

    keyed = nodes.select(F.explode(F.array(*keys)).alias("key"), "node", *prints)
    shared = work.put(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = join_hot(keyed, shared, ["key"], nodes.count() * BANDS)
    near = work.put(pigeonhole_links(nodes, own_work := Workspace(spark, "near_bits")), "near")
    own_work.drop("prints", "named", "classes", "edges", "roots")
    loose = loose_links(met, shared.where(F.col("n") > MOST_GROUP), similarity, MOST_GROUP).unionByName(near)
    groups = work.put(components(work.put(loose, "loose"), work), "groups")

    held = groups.join(nodes.select("node", *prints, "rid"), "node").select(F.col("root").alias("key"), "node", *prints, "rid")
    members = held.join(own.select("rid", "set"), "rid").drop("rid")  # one row of each text
    members = work.put(members, "members")
    large = work.put(groups.groupBy(F.col("root").alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > MOST_SETS), "large")
    roots = work.put(components(work.put(verified(members, large, similarity), "edges"), work), "roots")
    work.drop("shared", "near", "loose", "groups", "members", "large", "edges")

    rows = own.groupBy("doc_id", "node", "h", "g").agg(F.count("*").alias("n")).join(roots, "node", "left")
    rows = work.put(rows.select(F.coalesce("root", "node").alias("root"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "g").alias("row"), "n"), "rows")
    first = work.put(rows.groupBy("root").agg(F.min("row").alias("first"), F.count("*").alias("size")), "firsts")
    judged = join_hot(rows, first, ["root"], rows.count(), n_col="size")
    judged = judged.select(F.col("row.h").alias(one), F.col("row.g").alias(two), (F.col("row") == F.col("first")).alias("stays"), "n")
    judged = work.put(judged, "judged")
    work.drop("own", "nodes", "roots", "rows", "firsts")
    release(spark)
    kept = marked.join(judged.where(~F.col("stays")).select(one, two), [one, two], "left_anti")
    again = judged.where("stays and n > 1").select(one, two)
    if again.limit(1).count():  # of rows that are the same in all columns one stays
        once = kept.join(again, [one, two], "left_semi").dropDuplicates([one, two])
        kept = kept.join(again, [one, two], "left_anti").unionByName(once)
    return kept.select([F.col(f"`{c}`") for c in docs.columns])

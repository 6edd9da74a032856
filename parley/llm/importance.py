"""Resampling of documents towards a target distribution, by importance weights over hashed n-grams.

A position table holds every word of every text with its place. For each order above one a window over a
document's places looks ahead with ``lead`` and joins the following words to the n-gram that begins there.
N-grams are hashed into buckets and grouped; a bucket's gain is the log ratio of its share of the target to
its share of the corpus. Documents meet the gains in a join, and the ``k`` highest sums with Gumbel noise are
a sample without replacement in proportion to the weights. All counts are over all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Everything but digits, a-z and what lies beyond ASCII parts words once A-Z are lower-case.
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, SCALE, SEED, LEAST_WORDS, PERCENT = 10_000, 1000, 2024, 20, 10
#: The most rows whose order one task settles, and the most tasks: so many numbers a part table holds.
ROWS_A_PART, MOST_PARTS = 1 << 20, 50_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), DELIMITERS), "")


def position_table(docs: DataFrame, *, key: list[str], text_col: str) -> DataFrame:
    """(key.., pos, word): a row for each word; a text without words has one row whose word is null."""
    return docs.select(*key, F.posexplode_outer(words(F.col(text_col))).alias("pos", "word"))


def features(positions: DataFrame, *, key: list[str], least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key.., pos, bucket): the n-grams of ``least`` to ``most`` words that begin at each place, repeats included.

    Orders above one ask for a shuffle of the places by document; words alone stay where they are. A place where no
    n-gram of these orders begins keeps one row, whose bucket is null.
    """
    if not 1 <= least <= most:
        raise ValueError("orders go from one up")
    ahead = Window.partitionBy(*key).orderBy("pos")
    nexts = [F.lead("word", k).over(ahead).alias(f"w{k}") for k in range(1, most)]
    held = positions.select(*key, "pos", F.col("word").alias("w0"), *nexts)
    joined = [F.col("w0") if n == 1 else F.when(F.col(f"w{n - 1}").isNotNull(), F.concat_ws(" ", *[f"w{k}" for k in range(n)])) for n in range(1, most + 1)]
    grams = joined[least - 1 :]
    if len(grams) == 1:
        rows = held.select(*key, "pos", grams[0].alias("gram"))
    else:
        rows = held.select(*key, "pos", F.explode_outer(F.array_compact(F.array(*grams))).alias("gram"))
    return rows.select(*key, "pos", (F.crc32("gram") % F.lit(buckets)).cast("int").alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, work: Workspace, *, text_col: str = "text", target_text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """(bucket, s, t, gain) of every bucket; ``buckets`` rows, whatever the tables."""

    def counted(df: DataFrame, text: str, name: str) -> DataFrame:
        keyed = df.select(F.col(text).alias("text"))
        if most > 1:  # a window asks for something that tells rows apart
            keyed = keyed.withColumn("row", F.monotonically_increasing_id())
        key = ["row"] if most > 1 else []
        made = features(position_table(keyed, key=key, text_col="text"), key=key, least=least, most=most, buckets=buckets)
        return work.put(made.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name)), name)

    s, t = counted(docs, text_col, "s"), counted(target, target_text_col, "t")
    all_s, all_t = s.agg(F.sum("s")).head()[0] or 0, t.agg(F.sum("t")).head()[0] or 0
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    up = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    made = work.put(every.withColumn("gain", F.floor(F.lit(float(scale)) * F.log(up / down)).cast("long")), "gains")
    work.drop("s", "t")
    return made


def weigh(docs: DataFrame, bucket_gains: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row. ``bucket_gains`` has ``buckets`` rows at most, so it is broadcast."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    made = features(position_table(rows, key=["row", "doc_id"], text_col="text"), key=["row", "doc_id"], least=least, most=most, buckets=buckets)
    met = made.join(F.broadcast(bucket_gains.select("bucket", "gain")), "bucket", "left")
    # grouped by row alone: the few rows a document has left after the map side are all that is shuffled
    sums = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.coalesce(F.max("pos") + 1, F.lit(0)).cast("long").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return sums.drop("row")


def noise(id_col: Column, *, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise from a hash of the id, times ``scale``, floored; a null id is hashed as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, work: Workspace, *, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add rank (1, 2, 3.. of the drawn, null for others) by descending score, ties to the smaller id, null ids last.

    The rows are sorted by range, whatever the ties, and each keeps its place within its range; the ranges' sizes, a
    row each and at most ``MOST_PARTS`` of them, turn these into ranks. No task sees more than its range.
    """
    n, eligible = scored.agg(F.count("*"), F.count_if(F.col("n_words") >= least_words)).head()
    k = percent * eligible // 100
    parts = min(MOST_PARTS, n // ROWS_A_PART + 1)
    order = [(F.col("n_words") >= least_words).desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = work.put(dealt.withColumn("__at", F.monotonically_increasing_id()), "order")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select("__part", before.alias("__base")))
    rank = F.col("__base") + at + 1
    return placed.withColumn("__part", part).join(bases, "__part").withColumn("rank", F.when(rank <= k, rank)).drop("__part", "__base", "__at")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, scale: int = SCALE, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row, duplicates and rows without an id included.

    Null and empty texts have no features, weight 0 and, without ``least_words`` words, no rank. An empty target
    leaves every gain to the corpus alone; an empty corpus gives no rows. Ids must be numbers; other columns are
    ignored. A very long text is split into words in one task.
    """
    work = Workspace(docs.sparkSession, "importance")
    found = gains(docs, target, work, text_col=text_col, target_text_col=target_text_col, least=least, most=most, buckets=buckets, scale=scale)
    weighed = weigh(docs, found, id_col=id_col, text_col=text_col, least=least, most=most, buckets=buckets)
    scored = work.put(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed=seed, scale=scale)), "scored")
    ranked = draw(scored, work, percent=percent, least_words=least_words)
    work.drop("gains", "scored")
    return ranked


def oracle() -> str:
    """The contract in DuckDB SQL; crc32 goes by its table of 256 remainders, once for each distinct word."""
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
x AS (SELECT r, unnest(w) AS word FROM d),
y AS (SELECT unnest({split}) AS word FROM benchmark),
v AS (SELECT DISTINCT word FROM (SELECT word FROM x UNION ALL SELECT word FROM y)),
h AS (SELECT word, [('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(word))] AS b FROM v),
c AS (SELECT word, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, e: xor(a >> 8, t[(xor(a, e) & 255) + 1])), 4294967295::BIGINT) % 10000 AS INTEGER) AS bucket FROM h, tab),
s AS (SELECT bucket, count(*) AS s FROM x JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM y JOIN c USING (word) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)))) AS gain FROM s FULL JOIN t USING (bucket), z),
f AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM x JOIN c USING (word) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM d LEFT JOIN f USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS p, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT doc_id, n_features AS n_words, n_features, weight, weight + noise AS score, CASE WHEN p <= 10 * n // 100 THEN p END AS rank FROM e LEFT JOIN o USING (r)
"""

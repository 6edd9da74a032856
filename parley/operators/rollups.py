"""Aggregation of score tables: all slices are conditional aggregates over one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values above this are outliers; weights of the fitness.
OUTLIER = 2.0
WEIGHTS = {"saa": 0.7, "wer": 0.2, "gap": 0.1}


def trimmed_mean(column: str, most: float = OUTLIER) -> Column:
    """Mean of the values up to ``most``; of all values where none is."""
    return F.coalesce(F.avg(F.when(F.col(column) <= most, F.col(column))), F.avg(column))


def macro_columns() -> list[Column]:
    means = [F.avg(c).alias(f"mean_{c}") for c in ("wer", "cer", "saa", "cpwer", "gap")]
    trims = [trimmed_mean(c).alias(f"trimmed_{c}") for c in ("wer", "cer", "cpwer")]
    return [F.count("*").alias("n"), *means, *trims, (F.avg("latency_ms") / 1000).alias("mean_latency"), F.count_if(F.col("wer") > OUTLIER).alias("outliers")]


def macro_summary(scores: DataFrame, by: list[str] | None = None, baseline: str | None = None, variant: str = "strategy") -> DataFrame:
    """Means, trimmed means, latency and outliers of each group; with ``baseline``, the speedup against it.

    Each of wer, cer and cpwer is trimmed by its own values; outliers are counted by wer alone. The baseline
    is that of the same slice (the other columns of ``by``). No rows give no groups.
    """
    by = [variant] if by is None else by
    got = scores.groupBy(*by).agg(*macro_columns())
    if baseline is None:
        return got
    rest = [c for c in by if c != variant]
    known = F.forall(F.array(F.lit(True), *[F.col(c).isNotNull() for c in rest]), lambda x: x)  # no slice is that of a null
    base = F.max(F.when(F.col(variant) == baseline, F.col("mean_latency"))).over(Window.partitionBy(*rest))  # among the few rows of the result
    return got.withColumn("speedup", F.when(known & (F.col("mean_latency") > 0), base / F.col("mean_latency")))


def sliced(scores: DataFrame, slices: dict[str, Column], by: str = "strategy") -> DataFrame:
    """Means of any number of overlapping slices in one pass: (slice, by, n, means).

    A row goes to every slice whose predicate it meets; rows are not copied for the others.
    """
    named = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in slices.items()]))
    rows = scores.withColumn("slice", F.explode(named))
    return rows.groupBy("slice", by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in ("wer", "cer", "saa", "cpwer", "gap")], (F.avg("latency_ms") / 1000).alias("mean_latency"))


#: The slices of ``all_slices``: which of bucket and tier each level tells apart.
LEVELS = {"overall": (), "bucket": ("bucket",), "tier": ("tier",), "bucket_tier": ("bucket", "tier")}
DELTAS = ("wer", "cer", "saa", "cpwer", "gap")


def all_slices(scores: DataFrame, baseline: str, variant: str = "strategy", places: int = 6) -> DataFrame:
    """(level, bucket, tier, variant, n, means, trimmed means, mean_latency, outliers, seconds, speedup, delta_..): every rollup in one pass.

    ``scores`` has a bucket and a tier. Grouping sets give all levels from one scan and one shuffle of partial sums; the
    trimmed means are conditional sums of the same pass. Speedup and deltas are against the baseline of the same slice,
    found among the few rows of the result; they are null where a slice has no baseline. Numbers are rounded.
    """
    sets = [[variant, *keys] for keys in LEVELS.values()]
    columns = [*macro_columns(), (F.sum("duration_ms") / 1000).alias("seconds"), F.grouping_id().alias("__g")]
    got = scores.groupingSets(sets, variant, "bucket", "tier").agg(*columns)
    level = F.when(F.col("__g") == 3, "overall").when(F.col("__g") == 1, "bucket").when(F.col("__g") == 2, "tier").otherwise("bucket_tier")
    got = got.withColumn("level", level)
    same = Window.partitionBy("level", "bucket", "tier")
    base = lambda c: F.max(F.when(F.col(variant) == baseline, F.col(c))).over(same)
    speedup = F.when(F.col("mean_latency") > 0, base("mean_latency") / F.col("mean_latency")).alias("speedup")
    shifts = [(F.col(f"mean_{c}") - base(f"mean_{c}")).alias(f"delta_{c}") for c in DELTAS]
    wide = got.select("level", "bucket", "tier", variant, *[c for c in got.columns if c not in ("level", "bucket", "tier", variant, "__g")], speedup, *shifts)
    return wide.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in wide.dtypes])


def document(slices: DataFrame, variant: str = "strategy") -> DataFrame:
    """One row: ``all_slices`` folded into one nested document, levels, then slices, then variants.

    (overall: map of variant to numbers, by_bucket and by_tier: map of slice to such a map, by_bucket_and_tier: two deep.)
    The slices are few whatever the scores, so folding them gathers little.
    """

    def by_key(entries: Column) -> Column:
        return F.array_sort(entries, lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))

    numbers = [c for c in slices.columns if c not in ("level", "bucket", "tier", variant)]
    entry = F.struct(F.col(variant).alias("key"), F.struct(*numbers).alias("value"))
    per = slices.groupBy("level", "bucket", "tier").agg(F.map_from_entries(by_key(F.collect_list(entry))).alias("m"))
    tiers = per.where("level = 'bucket_tier'").groupBy("bucket").agg(F.map_from_entries(by_key(F.collect_list(F.struct(F.col("tier").alias("key"), "m")))).alias("tiers"))
    flat = per.select("level", F.coalesce("bucket", "tier", F.lit("")).alias("slice"), "m", F.lit(None).cast(tiers.schema["tiers"].dataType).alias("tiers")).where("level <> 'bucket_tier'")
    flat = flat.unionByName(tiers.select(F.lit("bucket_tier").alias("level"), F.col("bucket").alias("slice"), F.lit(None).cast(per.schema["m"].dataType).alias("m"), "tiers"))
    at = lambda name, value: by_key(F.collect_list(F.when(F.col("level") == name, F.struct(F.col("slice").alias("key"), F.col(value).alias("value")))))
    lists = flat.agg(at("overall", "m").alias("o"), at("bucket", "m").alias("b"), at("tier", "m").alias("t"), at("bucket_tier", "tiers").alias("bt"))
    return lists.select(F.get(F.col("o"), 0).value.alias("overall"), F.map_from_entries("b").alias("by_bucket"), F.map_from_entries("t").alias("by_tier"), F.map_from_entries("bt").alias("by_bucket_and_tier"))


def fitness(scores: DataFrame, by: list[str]) -> DataFrame:
    """Weighted accuracy, word score and gap score of each group, from means that are not rounded."""
    got = scores.groupBy(*by).agg(F.avg("saa").alias("saa"), F.avg("wer").alias("wer"), F.avg("gap").alias("gap"))
    good = lambda c: F.greatest(F.lit(0.0), 1 - F.col(c))
    return got.select(*by, (WEIGHTS["saa"] * F.col("saa") + WEIGHTS["wer"] * good("wer") + WEIGHTS["gap"] * good("gap")).alias("fitness"))


def deltas(summary: DataFrame, left: str, right: str, on: list[str], values: list[str], variant: str = "strategy") -> DataFrame:
    """left minus right of each value, per slice."""
    a = summary.where(F.col(variant) == left).select(*on, *[F.col(v).alias(f"__{v}") for v in values])
    b = summary.where(F.col(variant) == right).select(*on, *values)
    joined = a.join(b, on) if on else a.crossJoin(b)
    return joined.select(*on, *[(F.col(f"__{v}") - F.col(v)).alias(f"delta_{v}") for v in values])


def without(scores: DataFrame, ids: list[int], only: str, variant: str = "strategy") -> DataFrame:
    """Listed samples removed from one variant alone."""
    return scores.where(~((F.col(variant) == only) & F.col("sample_id").isin(ids)))


def long_form(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., metric, value): every number of a wide summary as a row."""
    values = [c for c in summary.columns if c not in keys]
    return summary.unpivot(keys, [F.col(v).cast("double").alias(v) for v in values], "metric", "value")


def recovery_rate(evidence: DataFrame, flag: str = "recovered") -> DataFrame:
    """(total, recovered, rate): per cent of rows recovered, 100 where there are none."""
    got = evidence.agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("recovered"))
    return got.withColumn("rate", F.when(F.col("total") > 0, F.round(100.0 * F.col("recovered") / F.col("total"), 1)).otherwise(100.0))

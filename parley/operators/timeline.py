"""Interval, sequence and bucketing operators over segments and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_duration(segments: DataFrame, key: str = "sample_id", speaker: str = "speaker", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(key, overlap): the measure of time in which two or more distinct speakers are active.

    A sweep: a speaker is active while any of their segments is open, so nested segments of one speaker
    count once; touching ends add nothing; a segment that ends before it starts is taken as it stands.
    Samples without segments give no row.
    """
    edges = segments.select(key, speaker, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(key, speaker, "e.t", "e.d")
    steps = edges.groupBy(key, speaker, "t").agg(F.sum("d").alias("d"))
    own = Window.partitionBy(key, speaker).orderBy("t")
    depth = steps.withColumn("depth", F.sum("d").over(own))
    active = (F.col("depth") > 0).cast("int")
    turns = depth.withColumn("step", active - F.coalesce(F.lag(active).over(own), F.lit(0)))
    moments = turns.groupBy(key, "t").agg(F.sum("step").alias("step"))
    line = Window.partitionBy(key).orderBy("t")
    live = moments.withColumn("live", F.sum("step").over(line)).withColumn("next", F.lead("t").over(line))
    return live.groupBy(key).agg(F.sum(F.when(F.col("live") >= 2, F.col("next") - F.col("t")).otherwise(0)).alias("overlap"))


def overlap_ratio(overlap: Column, duration: Column) -> Column:
    """Per cent of the duration; 0 for no duration."""
    return F.when(duration > 0, 100.0 * overlap / duration).otherwise(0.0)


def chronological(segments: DataFrame, key: str = "sample_id", start: str = "start_ms", pos: str = "pos") -> DataFrame:
    """Adds ``rank`` from 0 by start; equal starts keep their source order."""
    return segments.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(start, pos)) - 1)


def switches(turns: DataFrame, key: str = "sample_id", order: str = "turn_idx", speaker: str = "speaker") -> DataFrame:
    """(key, n_turns, n_speakers, switches, alternation, collapsed) of turns in order.

    ``alternation`` is switches over n - 1, 0 for one turn; ``collapsed`` is one speaker over four turns or more.
    """
    before = F.lag(speaker).over(Window.partitionBy(key).orderBy(order))
    t = turns.withColumn("__s", F.coalesce((before != F.col(speaker)).cast("int"), F.lit(0)))
    got = t.groupBy(key).agg(F.count("*").cast("int").alias("n_turns"), F.countDistinct(speaker).cast("int").alias("n_speakers"), F.sum("__s").cast("int").alias("switches"))
    n = F.col("n_turns")
    return got.withColumn("alternation", F.when(n > 1, F.col("switches") / (n - 1)).otherwise(0.0)).withColumn("collapsed", (F.col("n_speakers") < 2) & (n >= 4))


def dialogue(turns: DataFrame, key: str = "sample_id", order: str = "turn_idx", text: str = "text", out: str = "dialogue", separator: str = "\n", lead: Column | None = None) -> DataFrame:
    """(key, out): ``speaker: text`` lines in order; turns without text are left out."""
    line = F.concat(F.col("speaker") if lead is None else lead, F.lit(": "), F.col(text))
    rows = turns.where(F.col(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("l"))
    return rows.select(key, F.array_join("l.line", separator).alias(out))


def labels(turns: DataFrame, key: str = "sample_id", speaker: str = "speaker") -> DataFrame:
    """(key, labels): sorted distinct speakers."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_set(speaker)).alias("labels"))


def nested_turns(turns: DataFrame, key: str = "sample_id", order: str = "turn_idx") -> DataFrame:
    """(key, turns): an array of (speaker, text, start_time, end_time) in order, times in seconds."""
    t = F.struct(F.col(order).alias("o"), "speaker", "text", (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(t)).alias("t"))
    return rows.select(key, F.transform("t", lambda x: F.struct(x.speaker.alias("speaker"), x.text.alias("text"), x.start_time.alias("start_time"), x.end_time.alias("end_time"))).alias("turns"))


def summary_stats(samples: DataFrame, condition: str = "condition") -> DataFrame:
    """One row: count, total and mean duration, mean overlap, and counts by speakers and by condition."""
    one = samples.agg(F.count("*").alias("n"), F.sum("duration").alias("total_duration"), F.avg("duration").alias("mean_duration"), F.avg("overlap_ratio").alias("mean_overlap"))
    histogram = lambda c: samples.where(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).groupBy(F.col(c).cast("string").alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias(c))
    return one.crossJoin(histogram("num_speakers")).crossJoin(histogram(condition))


# Edges of the three slicings, which differ on purpose.
DURATION_EDGES = [(70, "<70s"), (180, "70s-180s"), (300, "180s-300s"), (None, "300s-600s")]
TIER_EDGES = [(16, "moderate_12_16_pct"), (20, "high_16_20_pct"), (None, "extreme_over_20_pct")]


def _half_open(value: Column, edges) -> Column:
    out = None
    for edge, name in edges:
        out = (F.when(value < edge, name) if out is None else out.when(value < edge, name)) if edge is not None else out.otherwise(name)
    return out


def duration_bucket(seconds: Column) -> Column:
    """Half-open buckets; the last has no upper end."""
    return _half_open(seconds, DURATION_EDGES)


def conflict_tier(overlap_pct: Column) -> Column:
    """Half-open tiers; the first has no lower end, whatever its name says."""
    return _half_open(overlap_pct, TIER_EDGES)


def overlap_slice(overlap_pct: Column) -> Column:
    """Below 5, from 5 to 12 with both ends, above 12."""
    return F.when(overlap_pct < 5, "low").when(overlap_pct <= 12, "moderate").otherwise("high")


def with_empty_slices(df: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with a row of zeros for every slice of ``dimension`` (a small table) that it lacks."""
    values = [c for c in df.columns if c not in on]
    return dimension.join(df, on, "left").select(*on, *[F.coalesce(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])).alias(c) for c in values])

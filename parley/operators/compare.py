"""Comparison of variants: joins on the sample, deltas, regressions and recovery evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["wer", "cer", "saa", "cpwer", "gap"]

#: A variant regresses where a delta passes its limit.
REGRESSION = {"saa": -0.02, "wer": 0.03, "cpwer": 0.03}


def pairwise(scores: DataFrame, new: str, old: str, variant: str = "strategy") -> DataFrame:
    """Per sample that both variants scored: deltas (new - old, 4 places), speedup and the regression flag.

    Limits are strict and apply to the rounded deltas; latencies under a millisecond count as one.
    """
    side = lambda name, p: scores.where(F.col(variant) == name).select("sample_id", *[F.col(c).alias(f"{p}_{c}") for c in [*METRICS, "latency_ms"]])
    both = side(new, "n").join(side(old, "o"), "sample_id")
    d = {c: F.round(F.col(f"n_{c}") - F.col(f"o_{c}"), 4) for c in METRICS}
    out = both.select("sample_id", *[v.alias(f"delta_{c}") for c, v in d.items()], (F.col("o_latency_ms") / F.greatest(F.col("n_latency_ms"), F.lit(1))).alias("speedup"))
    worse = (F.col("delta_saa") < REGRESSION["saa"]) | (F.col("delta_wer") > REGRESSION["wer"]) | (F.col("delta_cpwer") > REGRESSION["cpwer"])
    return out.withColumn("regressed", worse)


def overall(scores: DataFrame, new: str, old: str, variant: str = "strategy") -> DataFrame:
    """One row: differences of the two variants' means, each rounded first."""
    mean = lambda name, p: scores.where(F.col(variant) == name).agg(*[F.round(F.avg(c), 4).alias(f"{p}_{c}") for c in METRICS], F.avg("latency_ms").alias(f"{p}_latency"))
    both = mean(new, "n").crossJoin(mean(old, "o"))
    return both.select(*[F.round(F.col(f"n_{c}") - F.col(f"o_{c}"), 4).alias(f"delta_{c}") for c in METRICS], F.round(F.col("o_latency") / F.col("n_latency"), 3).alias("speedup"))


def side_by_side(samples: DataFrame, scores: DataFrame, variants: list[str], zero_missing: bool = False, variant: str = "strategy") -> DataFrame:
    """Every sample with each variant's saa and wer; a missing score stays null, or is 0 on request."""
    out = samples
    wide = scores.groupBy("sample_id").pivot(variant, variants).agg(F.first("saa").alias("saa"), F.first("wer").alias("wer"))
    out = samples.join(wide, "sample_id", "left")
    if zero_missing:
        out = out.fillna(0.0, [f"{v}_{m}" for v in variants for m in ("saa", "wer")])
    return out


def failures(table: DataFrame, light: str, strong: str, others: list[str], overlap: str = "overlap_ratio") -> DataFrame:
    """Samples where the light variant fails, or any other improves on it, with the best of the others.

    It fails below the strong one, or below 0.8 with more than 4 per cent overlap; improvement counts below
    0.99. ``recovered`` is best >= light.
    """
    a, b = F.col(f"{light}_saa"), F.col(f"{strong}_saa")
    best = F.greatest(*[F.col(f"{o}_saa") for o in others]) if len(others) > 1 else F.col(f"{others[0]}_saa")
    fails = (a < b) | ((a < 0.8) & (F.col(overlap) > 4))
    rows = table.where(fails | ((a < 0.99) & (best > a)))
    return rows.select("sample_id", a.alias("light"), b.alias("strong"), best.alias("best"), (best >= a).alias("recovered"))


def recoveries(tries: list[DataFrame], light: DataFrame, strong: DataFrame) -> DataFrame:
    """Full outer over the ids of all score tables; rows with a try, whose light score is below the strong one.

    ``recovered`` is best >= strong - 0.05, or a gain over the light one above 0.15; missing scores are 0.
    """
    every, names = None, []
    for name, df in [*((f"__t{i}", t) for i, t in enumerate(tries)), ("light", light), ("strong", strong)]:
        one = df.select("sample_id", F.col("saa").alias(name))
        every = one if every is None else every.join(one, "sample_id", "full_outer")
        names.append(name)
    tried = [F.col(n) for n in names[:-2]]
    seen = F.coalesce(*tried).isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    best = F.greatest(*map(zero, tried)) if len(tried) > 1 else zero(tried[0])
    a, b = zero(F.col("light")), zero(F.col("strong"))
    return every.where(seen & (a < b)).select("sample_id", best.alias("best"), (best - a).alias("gain"), ((best >= b - 0.05) | (best - a > 0.15)).alias("recovered"))


def worst(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k samples of least saa - gap; ties in sample order."""
    return scores.orderBy(F.col("saa") - F.col("gap"), "sample_id").limit(k)


def consistent(reported: DataFrame, recomputed: DataFrame, on: list[str], values: list[str], tolerance: float = 1e-3) -> DataFrame:
    """(on.., metric, reported, recomputed, ok) of every value of both tables."""
    a = reported.unpivot(on, values, "metric", "reported")
    b = recomputed.unpivot(on, values, "metric", "recomputed")
    return a.join(b, [*on, "metric"]).withColumn("ok", F.abs(F.col("reported") - F.col("recomputed")) <= tolerance)


def against_constants(summary: DataFrame, constants: DataFrame, values: list[str]) -> DataFrame:
    """Each variant's means minus those of each named baseline row of a small constants table."""
    base = constants.select(F.col("name").alias("baseline"), *[F.col(v).alias(f"__{v}") for v in values])
    return summary.crossJoin(base).select("strategy", "baseline", *[(F.col(v) - F.col(f"__{v}")).alias(f"delta_{v}") for v in values])


def subset_or_first(samples: DataFrame, ids: list[int], k: int = 3) -> DataFrame:
    """The listed samples if any is there, else the first k by id."""
    listed = samples.where(F.col("sample_id").isin(ids))
    any_ = listed.limit(1).agg((F.count("*") > 0).alias("__any"))
    first = samples.orderBy("sample_id").limit(k).crossJoin(any_).where(~F.col("__any")).drop("__any")
    return listed.unionByName(first)

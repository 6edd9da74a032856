"""Command lines: ``python -m parley score | compile | missing | queries``.

Every path may be any that Spark reads. Settings come from arguments; those that are left out come from the environment
(``PARLEY_MASTER``, ``PARLEY_BUCKETS``, ``PARLEY_KEEP``), else from their defaults. Results are always stored before anything is
summed up from them.
"""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import results, rollups, scoring, timeline
from .sources import files
from .sources.store import BucketStore

KEY = ["sample_id", "strategy"]


@dataclass(frozen=True)
class Settings:
    """What a run can be told; ``of`` takes arguments first, then the environment."""

    master: str | None = None
    buckets: int = 64
    keep: int = 3

    @classmethod
    def of(cls, args: argparse.Namespace) -> Settings:
        def pick(name: str, kind: type):
            given = getattr(args, name, None)
            given = os.environ.get(f"PARLEY_{name.upper()}") if given is None else given
            return getattr(cls, name) if given is None else kind(given)

        return cls(pick("master", str), pick("buckets", int), pick("keep", int))


def session(settings: Settings) -> SparkSession:
    made = SparkSession.builder.appName("parley").config("spark.sql.session.timeZone", "UTC")
    return (made.master(settings.master) if settings.master else made).getOrCreate()


def scored(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """(key, sample_id, strategy, duration_ms, num_speakers, bucket, tier, metrics, latency_ms, pos) of every prediction.

    The name of a prediction is its strategy, else its approach, else its model. Of several predictions of one name for a
    sample the one with turns goes first.
    """
    name = F.coalesce("strategy", "approach", "model_id", F.lit("unnamed"))
    p = predictions.where("sample_id is not null").select("sample_id", name.alias("strategy"), "latency_seconds", F.coalesce("predicted_turns", F.array().cast(predictions.schema["predicted_turns"].dataType)).alias("turns"))
    p = p.groupBy(*KEY).agg(F.max_by(F.struct("latency_seconds", "turns"), F.size("turns")).alias("p")).select(*KEY, "p.*")
    turn = lambda c: F.posexplode(c).alias("turn_idx", "t")
    hyp = p.select(*KEY, turn("turns")).select(*KEY, "turn_idx", "t.speaker", "t.text")
    ref = samples.select("sample_id", turn("ground_truth_turns")).select("sample_id", "turn_idx", "t.speaker", "t.text")
    facts = samples.select("sample_id", (F.col("duration_seconds") * 1000).cast("long").alias("duration_ms"), "num_speakers", timeline.duration_bucket(F.col("duration_seconds")).alias("bucket"), timeline.conflict_tier(F.col("overlap_ratio")).alias("tier"))
    known = p.join(facts, "sample_id")  # predictions of unknown samples are left out
    got = scoring.evaluate(known.select(*KEY), ref, hyp).drop("mapping", "format_valid").join(known.drop("turns"), KEY)
    latency = F.round(F.col("latency_seconds") * 1000).cast("long")
    return got.withColumn("latency_ms", latency).drop("latency_seconds").withColumn("key", F.concat_ws("|", *KEY)).withColumn("pos", F.lit(0))


def score(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> None:
    """Scores predictions and merges them into the store as a version; a version that stands already is left as it is."""
    samples, predictions = files.read_samples(spark, args.metadata), files.read_predictions(spark, args.predictions)
    store = BucketStore(spark, args.store, "key", "pos", settings.buckets, settings.keep)
    stored = store.put(scored(samples, predictions), args.version)
    print(f"version {args.version}: " + ("stored" if stored else "there already") + f", {store.current().count()} scores in all")


def compile_summary(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> None:
    """Writes the nested summary of a stored version, the newest unless one is named."""
    store = BucketStore(spark, args.store, "key", "pos", settings.buckets, settings.keep)
    versions = store.versions()
    if not versions:
        raise SystemExit(f"nothing is stored under {args.store}")
    number = versions[-1] if args.version is None else args.version
    slices = store.compile(number, lambda df: rollups.all_slices(df, args.baseline), f"slices-{args.baseline}")
    files.write_document(rollups.document(slices), args.out)
    print(f"version {number}: {slices.where(F.col('level') == 'overall').count()} strategies summed up in {args.out}")


def missing(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> None:
    """Prints the samples that no prediction with turns covers, at most ``--most`` of them."""
    found = results.valid(files.read_predictions(spark, args.predictions))
    gone = results.missing(files.read_samples(spark, args.metadata), found)
    for r in gone.orderBy("sample_id").limit(args.most).collect():
        print(r["sample_id"])


def run_query(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> None:
    """Lists the queries, or shows the first rows of one over a folder of tables."""
    from . import queries as own

    own.load()
    if args.name is None:
        print("\n".join(sorted(own.QUERIES)))
    elif args.name not in own.QUERIES:
        raise SystemExit(f"no query {args.name}")
    else:
        own.QUERIES[args.name](spark, args.data).show(args.most, truncate=60)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parley", description="Scores, summaries and queries of conversations.")
    p.add_argument("--master", help="the cluster; the session's own if left out")
    p.add_argument("--buckets", type=int, help="parts of the store")
    p.add_argument("--keep", type=int, help="versions of the store that stay")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, f, /, **options) -> None:
        own = sub.add_parser(command, help=f.__doc__.split(";")[0].splitlines()[0])
        for option, settings in options.items():
            own.add_argument("--" + option, **settings)
        own.set_defaults(run=f)

    path = {"required": True}
    add("score", score, metadata=path, predictions=path, store=path, version={"type": int, "required": True})
    add("compile", compile_summary, store=path, out=path, baseline={"default": "baseline"}, version={"type": int})
    add("missing", missing, metadata=path, predictions=path, most={"type": int, "default": 1000})
    add("queries", run_query, name={}, data={"default": "."}, most={"type": int, "default": 20})
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    settings = Settings.of(args)
    args.run(session(settings), args, settings)


if __name__ == "__main__":
    main()

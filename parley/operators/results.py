"""Result sets: completeness, resume, upsert, priority merge, subset names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def missing(expected: DataFrame, found: DataFrame, key: str = "sample_id") -> DataFrame:
    """Expected ids that are not there."""
    return expected.select(key).distinct().join(found.select(key), key, "left_anti")


def require_complete(expected: DataFrame, found: DataFrame, key: str = "sample_id") -> None:
    gone = [r[0] for r in missing(expected, found, key).limit(20).collect()]
    if gone:
        raise ValueError(f"samples are missing, among them: {gone}")


def listed(df: DataFrame, ids: list, key: str = "sample_id") -> DataFrame:
    """Rows of the listed ids with ``pos``, their place in the list; one row an id. The list is an argument, so small."""
    order = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"{key} {dict(df.dtypes)[key]}, pos int")
    return F.broadcast(order).join(df.dropDuplicates([key]), key)


def get(df: DataFrame, value, key: str = "sample_id"):
    row = df.where(F.col(key) == value).head()
    if row is None:
        raise KeyError(value)
    return row


def valid(records: DataFrame, turns: str = "predicted_turns") -> DataFrame:
    """Records with at least one predicted turn."""
    return records.where(F.size(turns) > 0)


def upsert(old: DataFrame, new: DataFrame, key: str = "sample_id", pos: str = "pos") -> DataFrame:
    """New records replace old ones under their key and keep the old place; unseen ones follow in their order."""
    a, b = (t.withColumn("__new", F.lit(n)) for n, t in enumerate((old, new)))
    every = a.unionByName(b)
    latest = Window.partitionBy(key).orderBy(F.col("__new").desc(), F.col(pos).desc())
    first = Window.partitionBy(key)
    place = F.struct("__new", pos)
    picked = every.withColumn("__place", F.min(place).over(first)).withColumn("__r", F.row_number().over(latest)).where("__r = 1")
    columns = [c for c in old.columns if c != pos]
    return picked.select(*columns, F.col("__place.__new").alias("is_new"), F.col(f"__place.{pos}").alias(pos))


def coalesce_sets(sets: list[tuple[str, DataFrame]], key: str = "sample_id") -> DataFrame:
    """One record a key, from the first set that has it; ``source`` names the set."""
    every = None
    for i, (name, df) in enumerate(sets):
        tagged = df.withColumn("source", F.lit(name)).withColumn("__p", F.lit(i))
        every = tagged if every is None else every.unionByName(tagged, allowMissingColumns=True)
    best = Window.partitionBy(key).orderBy("__p")
    return every.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__p", "__r")


def to_do(samples: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    return samples.join(done.select(key), key, "left_anti")


def partial_name(path: Column, is_subset: Column) -> Column:
    """A run over a subset writes beside the full file."""
    return F.when(is_subset, F.regexp_replace(path, r"(\.[A-Za-z0-9]+)$", "_partial$1")).otherwise(path)


def audio_path(path: Column, file: Column, sample: Column) -> Column:
    """The stated path, else the stated file, else audio/{id}.wav; blank counts as not stated."""
    set_ = lambda c: F.when(c != "", c)
    return F.coalesce(set_(path), set_(file), F.concat(F.lit("audio/"), sample.cast("string"), F.lit(".wav")))


def is_missing(error: Exception) -> bool:
    """Whether a read failed because its path isn't there, and for no other reason."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    return condition.startswith("PATH_NOT_FOUND")


def tolerant(spark: SparkSession, path: str, schema, multi_line: bool = True) -> DataFrame:
    """JSON records of a path; none if it is missing, and none from records that cannot be parsed. Other failures are raised."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return spark.createDataFrame([], schema)

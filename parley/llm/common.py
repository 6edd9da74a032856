"""Helpers shared by the operators: work tables in the shared folder, and size-derived counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) is a temporary folder made and remembered.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("parley.work.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("parley.work.dir", named)
    return named.rstrip("/")


class Workspace:
    """Named Parquet tables in the shared folder; they cut lineage and outlive lost executors.

    ``put`` writes a frame and returns a scan of the written files. ``drop`` deletes a table that
    no returned frame reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/parley-{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of finished steps (it acts on driver garbage)."""
    spark.sparkContext._jvm.System.gc()


def unit_hash(*cols):
    """A hash of columns as a number from 0 to 1, for samples that any scan of the table draws alike."""
    return F.xxhash64(*cols) / F.lit(2.0**64) + F.lit(0.5)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], total: int, *, how: str = "inner", share: float = 1e-4, n_col: str = "n") -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, with no key's rows gathered in one task.

    ``right`` has each key once with ``n_col``, how many of the ``total`` rows of ``left`` hold it (or more). At most
    1 / ``share`` keys can each hold more than that share, so those are broadcast; the rest are shuffled. Both sides
    should be cheap to read twice. ``how`` is inner or left.
    """
    many = F.col(n_col) > F.lit(max(total * share, 1000.0))
    hot, cold = right.where(many).drop(n_col), right.where(~many).drop(n_col)
    if not hot.limit(1).count():
        return left.join(right.drop(n_col), keys, how)
    bare = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(bare.join(cold, keys, how))


def spare(docs: DataFrame, *wanted: str) -> tuple[str, ...]:
    """Column names like the wanted ones that ``docs`` doesn't have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        out.append(name)
    return tuple(out)


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a few MB of text, so that a task's memory doesn't grow with the texts' length.

    A limit that the session already holds below the default stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b").rstrip("b") == "67108864":
        spark.conf.set(key, BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_bucket(col: str, n: int):
    """crc32 of the id written as text, modulo n (null for a null id)."""
    return (F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)).cast("int")

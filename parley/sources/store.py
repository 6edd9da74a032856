"""A keyed table in buckets that batches are merged into; a manifest names the live files, so work follows the batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import is_missing, upsert

MANIFEST = "number long, bucket int, path string, stamp string"


class BucketStore:
    """One current row a key under ``root``, kept in ``buckets`` parts by a hash of the key.

    ``put`` rewrites only the buckets that a batch touches and names the new files in a manifest, written last: until then
    readers see the version before, and a batch that dies leaves files that nothing names. A batch that comes again
    changes nothing. ``compile`` makes summaries from a named version. The newest ``keep`` manifests stay; what none of
    them names is removed after each batch.

    Keys may be of any type with a hash; null keys are one key. An empty batch makes a version without changes.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "sample_id", pos: str = "pos", buckets: int = 64, keep: int = 3):
        if buckets < 1 or keep < 1:
            raise ValueError("a bucket and a version at least")
        self.spark, self.root, self.key, self.pos, self.buckets, self.keep = spark, root.rstrip("/"), key, pos, buckets, keep

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list:
        """Rows of all manifests that stand: ``buckets`` times ``keep`` at most."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/*").collect()
        except AnalysisException as e:
            if not is_missing(e):
                raise
            return []
        return rows

    def versions(self) -> list[int]:
        return sorted({r["number"] for r in self._manifests()})

    def _live(self, number: int | None = None) -> tuple[int, dict[int, str]]:
        """(version, bucket -> path) of a version, the newest by default; of two writes of one number the later stamp counts."""
        rows = [r for r in self._manifests() if number is None or r["number"] == number]
        if not rows:
            return -1, {}
        top = max((r["number"], r["stamp"]) for r in rows)
        return top[0], {r["bucket"]: r["path"] for r in rows if (r["number"], r["stamp"]) == top and r["bucket"] is not None}

    def _scan(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*sorted(f"{self.root}/{p}" for p in paths)) if paths else None

    def current(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, or None before the first."""
        return self._scan(list(self._live(number)[1].values()))

    def put(self, batch: DataFrame, number: int) -> bool:
        """Merges a batch as version ``number``; False if that version or a later one stands already."""
        top, live = self._live()
        if number <= top:
            return False
        stamp = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        batch = batch.withColumn("__bucket", self._bucket())
        touched = [r[0] for r in batch.select("__bucket").distinct().collect()]  # no more than there are buckets
        old = self._scan([live[b] for b in touched if b in live])
        own = batch.drop("__bucket")
        merged = upsert(own.where("false") if old is None else old, own, self.key, self.pos).drop("is_new")
        if touched:
            dealt = merged.withColumn("__bucket", self._bucket())
            dealt.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/data/{stamp}")
        named = live | {b: f"data/{stamp}/__bucket={b}" for b in touched}
        rows = [(number, b, p, stamp) for b, p in sorted(named.items())] or [(number, None, None, stamp)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{self.root}/manifests/{stamp}")
        self._clean()
        return True

    def compile(self, number: int, summary: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """A summary of version ``number``, written once under its name and read back; rerunning reads what stands."""
        if number not in self.versions():
            raise ValueError(f"version {number} is not there; these are: {self.versions()}")
        path = f"{self.root}/summaries/{name}/{number:012d}"
        made = summary(self.current(number))
        if not self._exists(f"{path}/_SUCCESS"):
            made.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(made.schema).parquet(path)

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def _clean(self) -> None:
        """Removes manifests before the newest ``keep`` and the data that no manifest names, of finished batches alone."""
        rows = self._manifests()
        stamps = sorted({r["stamp"] for r in rows})
        kept = set(stamps[-self.keep :])
        named = {r["path"].split("/")[1] for r in rows if r["stamp"] in kept and r["path"]}
        for s in stamps:
            if s not in kept:
                where, fs = self._fs(f"{self.root}/manifests/{s}")
                fs.delete(where, True)
        where, fs = self._fs(f"{self.root}/data")
        for status in fs.listStatus(where) if fs.exists(where) else []:
            name = status.getPath().getName()
            if name not in named and int(name.split("-")[0]) <= int(stamps[-1].split("-")[0]):
                fs.delete(status.getPath(), True)

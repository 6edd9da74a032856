"""Bucketed merges, manifests and compiled summaries; the one-pass rollups and their document."""

import pytest
from pyspark.sql import functions as F

from parley.operators import rollups
from parley.sources import files
from parley.sources.store import BucketStore

SCHEMA = "sample_id string, v int, pos int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_batches_merge_and_keep_places(spark, tmp_path):
    s = BucketStore(spark, str(tmp_path), buckets=8)
    assert s.current() is None and s.versions() == []
    assert s.put(frame(spark, [("a", 1, 0), ("b", 2, 1), ("c", 3, 2)]), 1)
    before = s._live()[1]
    assert s.put(frame(spark, [("b", 9, 0), ("d", 4, 1)]), 2)
    after = s._live()[1]
    assert rows_of(s.current().select("sample_id", "v")) == [("a", 1), ("b", 9), ("c", 3), ("d", 4)]
    assert s.current().where("sample_id = 'b'").head().pos == 1
    touched = {r[0] for r in frame(spark, [("b", 9, 0), ("d", 4, 1)]).select(s._bucket()).collect()}
    assert {b for b in after if before.get(b) != after[b]} == touched  # the others keep their files
    assert rows_of(s.current(1).select("sample_id", "v")) == [("a", 1), ("b", 2), ("c", 3)]
    assert not s.put(frame(spark, [("a", 0, 0)]), 2) and not s.put(frame(spark, [("a", 0, 0)]), 1)
    assert s.put(frame(spark, []), 3) and s.current().count() == 4


def test_a_batch_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    s = BucketStore(spark, str(tmp_path), buckets=4)
    s.put(frame(spark, [("a", 1, 0), ("b", 2, 1)]), 1)
    batch = frame(spark, [("b", 7, 0), (None, 5, 1)])
    monkeypatch.setattr(spark, "createDataFrame", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        s.put(batch, 2)
    monkeypatch.undo()
    assert s.versions() == [1] and rows_of(s.current().select("v")) == [(1,), (2,)]
    assert s.put(batch, 2)
    assert rows_of(s.current().select("v")) == [(1,), (5,), (7,)]
    assert len(list((tmp_path / "data").iterdir())) == 2  # what the dead batch left is gone


def test_old_versions_go(spark, tmp_path):
    s = BucketStore(spark, str(tmp_path), buckets=1, keep=2)
    for k in range(1, 5):
        s.put(frame(spark, [("a", k, 0)]), k)
    assert s.versions() == [3, 4] and s.current().head().v == 4
    assert len(list((tmp_path / "data").iterdir())) == 2
    with pytest.raises(ValueError):
        s.compile(1, lambda df: df, "x")
    with pytest.raises(ValueError):
        BucketStore(spark, str(tmp_path), keep=0)


def test_summaries_are_of_a_named_version(spark, tmp_path):
    s = BucketStore(spark, str(tmp_path), buckets=3)
    s.put(frame(spark, [("a", 1, 0), ("b", 2, 1)]), 1)
    total = lambda df: df.agg(F.sum("v").alias("total"))
    assert s.compile(1, total, "total").head().total == 3
    s.put(frame(spark, [("a", 10, 0)]), 2)
    assert s.compile(1, total, "total").head().total == 3 and s.compile(2, total, "total").head().total == 12


SCORES = [(i, st, 60_000 * (1 + i % 5), b, t, float(i % 4), 0.1 * i, 0.5 + 0.01 * i, 0.2 * i, 0.05 * i, 1000 * (1 + (st == "base")) + i) for i in range(40) for st in ("base", "new") for b, t in [("short" if i % 2 else "long", "calm" if i % 3 else "hot")]]
SCORE_SCHEMA = "sample_id int, strategy string, duration_ms long, bucket string, tier string, wer double, cer double, saa double, cpwer double, gap double, latency_ms long"


def test_all_slices_come_from_one_scan(spark, tmp_path):
    spark.createDataFrame(SCORES, SCORE_SCHEMA).write.parquet(str(tmp_path / "s"))
    scores = spark.read.parquet(str(tmp_path / "s"))
    got = rollups.all_slices(scores, "base")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Aggregate [") == 1
    rows = {(r.level, r.bucket, r.tier, r.strategy): r for r in got.collect()}
    for keys, level in ((["strategy"], "overall"), (["bucket", "strategy"], "bucket"), (["tier", "strategy"], "tier"), (["bucket", "tier", "strategy"], "bucket_tier")):
        for w in rollups.macro_summary(scores, keys, "base").collect():
            g = rows.pop((level, w["bucket"] if "bucket" in keys else None, w["tier"] if "tier" in keys else None, w["strategy"]))
            assert g.n == w.n and all(g[c] == pytest.approx(w[c], abs=1e-6) for c in ("mean_wer", "trimmed_wer", "trimmed_cpwer", "mean_latency", "speedup", "outliers"))
    assert not rows


def test_document_comes_back(spark, tmp_path):
    made = rollups.document(rollups.all_slices(spark.createDataFrame(SCORES, SCORE_SCHEMA), "base"))
    files.write_document(made, str(tmp_path / "d"))
    back = files.read_document(spark, str(tmp_path / "d"), made.schema)
    assert back.collect() == made.collect() and back.count() == 1
    doc = back.head()
    assert set(doc.overall) == {"base", "new"} and doc.by_bucket["long"]["base"].speedup == 1.0 and doc.by_bucket_and_tier["short"]["hot"]["new"].n > 0


def test_document_of_nothing(spark):
    doc = rollups.document(rollups.all_slices(spark.createDataFrame([], SCORE_SCHEMA), "base")).head()
    assert doc.overall is None and doc.by_bucket == {}


def test_clips_are_rendered_once(spark, tmp_path):
    import numpy as np

    from parley.sources.clips import ClipStore

    def padded(speaker, text):
        return np.concatenate([np.zeros(4000), 0.2 * np.sin(np.arange(3200) / 5), np.zeros(6000)])

    s = ClipStore(spark, str(tmp_path / "c"))
    want = spark.createDataFrame([("a", "one two"), ("a", "one two"), ("b", "one two"), ("a", None), (None, "x"), ("a", "")], "speaker string, text string")
    assert s.read().count() == 0 and s.missing(want).count() == 3
    assert s.add(want, padded) == 3 and s.add(want, padded) == 0
    rows = s.read().withColumn("h", files.check_wav("audio")).collect()
    assert len(rows) == 3 and all(r.h.ok and r.h.frames == r.frames for r in rows)
    assert all(3200 + 900 < r.frames <= 3200 + 961 for r in rows)  # 30 ms of the silence are left on each side
    level = np.sqrt(np.mean((np.frombuffer(bytes(rows[0].audio)[44:], "<i2") / 32767.0) ** 2))
    assert level == pytest.approx(0.12, abs=0.01)
    assert s.add(want.union(spark.createDataFrame([("c", "new")], "speaker string, text string")), padded) == 1
    assert ClipStore(spark, str(tmp_path / "c"), settings="2.0").missing(want).count() == 3

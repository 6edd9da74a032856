import random

import numpy as np

from parley.operators import synth, timeline


def brute(segs):
    """Millisecond by millisecond."""
    end = max(e for _, _, e in segs)
    live = [set() for _ in range(end)]
    for s, a, b in segs:
        for t in range(a, b):
            live[t].add(s)
    return sum(len(x) >= 2 for x in live)


def test_overlap_against_brute_force(spark):
    r = random.Random(3)
    calls = {k: [(r.choice("abc"), s := r.randint(0, 80), s + r.randint(0, 40)) for _ in range(r.randint(1, 12))] for k in range(40)}
    df = spark.createDataFrame([(k, *s) for k, v in calls.items() for s in v], "sample_id int, speaker string, start_ms int, end_ms int")
    got = {x.sample_id: x.overlap for x in timeline.overlap_duration(df).collect()}
    assert got == {k: brute(v) for k, v in calls.items()}


def test_touching_nested_and_same_speaker(spark):
    rows = [(1, "a", 0, 10), (1, "b", 10, 20), (2, "a", 0, 10), (2, "a", 2, 5), (3, "a", 0, 10), (3, "b", 2, 5)]
    df = spark.createDataFrame(rows, "sample_id int, speaker string, start_ms int, end_ms int")
    assert {x.sample_id: x.overlap for x in timeline.overlap_duration(df).collect()} == {1: 0, 2: 0, 3: 3}


def test_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in (69.9, 70.0, 180.0, 300.0)], "x double").select(timeline.duration_bucket(F.col("x")))
    assert [r[0] for r in df.collect()] == ["<70s", "70s-180s", "180s-300s", "300s-600s"]
    df = spark.createDataFrame([(x,) for x in (4.9, 5.0, 12.0, 12.1, 16.0, 20.0)], "x double").select(timeline.overlap_slice(F.col("x")), timeline.conflict_tier(F.col("x")))
    assert [r[0] for r in df.collect()] == ["low", "moderate", "moderate", "high", "high", "high"]
    assert [r[1][:4] for r in df.collect()] == ["mode", "mode", "mode", "mode", "high", "extr"]


def test_fitted_timelines(spark):
    from parley.queries import load, rollups

    load()
    d = "/root/testdata/sf0.001"
    t = rollups.l08_timelines(spark, d)
    specs = synth.specifications(spark)
    rows = t.join(specs, "spec").groupBy("spec", "duration_ms").agg({"end_ms": "max", "turn_idx": "count"}).collect()
    assert len(rows) == 50
    assert all(0.8 * r.duration_ms <= r["max(end_ms)"] <= r.duration_ms for r in rows)
    assert rollups.l13_self_check(spark, d).head().enough_overlap


def test_audio_shapes():
    x = np.concatenate([np.zeros(1600), 0.5 * np.ones(1600), np.zeros(1600)])
    t = synth.trim(x)
    assert 1600 < len(t) < 3000 and np.abs(t).max() <= synth.CLIP
    tone = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    hum = np.sin(2 * np.pi * 50 * np.arange(16000) / 16000)
    assert np.std(synth.band(tone, 250, 3600)) > 0.65 and np.std(synth.band(hum, 250, 3600)) < 0.05

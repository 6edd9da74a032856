"""What has to hold at any size: no side of a join whole in the driver, each score computed once, bounded batches."""

import random

import pytest

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d06_confusion", "d07_assignment", "d08_speaker_accuracy", "d10_cost_cells", "d11_least_cost", "d12_cpwer", "d14_evaluate"])
def test_gathered_turns_are_never_broadcast(spark, name):
    from parley.queries import scoring

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        assert "BroadcastHashJoin" not in plan(getattr(scoring, name)(spark, DIR))[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["d10_cost_cells", "d11_least_cost", "d12_cpwer"])
def test_documents_are_compared_by_bit_vectors(spark, name):
    from parley.queries import scoring

    logical, _ = plan(getattr(scoring, name)(spark, DIR))
    assert "levenshtein" not in logical and logical.count("Relation [") == 2


@pytest.mark.parametrize("name", ["flagship", "h01_macro_summary", "h08_tier_rollup", "h13_all_slices"])
def test_a_baseline_costs_no_second_scoring(spark, name):
    from parley.queries import rollups

    logical, _ = plan(getattr(rollups, name)(spark, DIR))
    assert logical.count("Relation [") == 1


@pytest.mark.parametrize("name", ["a18_summary_document", "i11_prompt_search", "i13_consistency"])
def test_what_is_read_twice_is_scored_once(spark, name, monkeypatch):
    """Everything after the one stored table reads no conversations."""
    from parley.queries import rollups

    got, made = [], rollups.stored
    monkeypatch.setattr(rollups, "stored", lambda df, n: got.append(plan(df)[0]) or made(df, n))
    df = getattr(rollups, name)(spark, DIR)
    assert len(got) == 1 and got[0].count("Relation [") == 1
    assert "_speaker_match" not in plan(df)[0]
    if name == "i11_prompt_search":
        assert "long_character_distance" not in got[0]


def test_null_slices_have_no_baseline(spark):
    from parley.operators import rollups

    rows = [("a", "base", 2), ("a", "new", 1), (None, "base", 2), (None, "new", 1)]
    columns = "k string, strategy string, latency_ms long, wer double, cer double, saa double, cpwer double, gap double"
    s = spark.createDataFrame([(*r, *[0.0] * 5) for r in rows], columns)
    got = {(r.k, r.strategy): r.speedup for r in rollups.macro_summary(s, ["k", "strategy"], "base").collect()}
    assert got == {("a", "base"): 1.0, ("a", "new"): 2.0, (None, "base"): None, (None, "new"): None}


@pytest.mark.parametrize("slack", [1, 3, 32])
def test_banded_distance(monkeypatch, slack):
    from parley.functions import distance

    monkeypatch.setattr(distance, "SLACK", slack)
    draw, banded = random.Random(slack), []
    own = distance._within
    monkeypatch.setattr(distance, "_within", lambda *a: banded.append(own(*a)) or banded[-1])
    for n in range(600):
        a = "".join(draw.choice("abcdef") for _ in range(draw.randint(0, 300)))
        b = "".join(c if draw.random() > 0.1 else draw.choice(["", "x", c + c, "y" + c]) for c in a)
        a, b = (a, b) if n % 2 else (b, a)
        b = "".join(draw.choice("abc") for _ in range(100)) if n % 10 == 0 else b
        assert distance.character_distance(a, b) == distance.edit_distance(list(a), list(b))
    assert len(banded) > 100


def test_contained_sides_need_no_table(monkeypatch):
    from parley.functions import assignment

    draw = random.Random(5)
    cases = []
    for _ in range(200):
        a = [draw.choice("abc") for _ in range(draw.randint(1, 40))]
        b = [c for c in a if draw.random() > 0.2]
        cases += [(a, b), (b, a)]
    fast = [assignment.align(*c) for c in cases]
    tables = []
    own = assignment._column
    monkeypatch.setattr(assignment, "_column", lambda *a: tables.append(1) or own(*a))
    assert [assignment.align(*c) for c in cases] == fast and not tables
    monkeypatch.setattr(assignment, "_contained", lambda *a: None)
    assert [assignment.align(*c) for c in cases] == fast and tables


def test_clips_leave_a_task_in_bounded_batches(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from parley.sources import clips

    s = clips.ClipStore(spark, str(tmp_path / "c"))
    many = spark.range(3000).select(F.lit("a").alias("speaker"), F.concat(F.lit("one two three four " * 5), F.col("id").cast("string")).alias("text"))
    made = []
    monkeypatch.setattr(s, "missing", lambda wanted: type("Rows", (), {"mapInPandas": lambda self, f, schema: made.append(f) or s._stored()})())
    s._stored().write.parquet(str(tmp_path / "c" / "empty"))
    s.add(many)
    frames = list(made[0](iter([many.select(F.col("text").alias("key"), "speaker", "text").toPandas()])))
    assert sum(map(len, frames)) == 3000 and len(frames) > 1
    assert max(f.audio.map(len).sum() for f in frames) < 2 * clips.MOST_BYTES


def test_clips_move_no_audio_and_a_second_run_no_text(spark, tmp_path):
    import os

    from parley.queries import rollups
    from parley.sources import clips

    used = [line.strip(" :+-") for line in plan(rollups.l03_clips(spark, DIR))[0].splitlines() if "audio" in line]
    assert used and all(line.startswith(("Project", "Relation")) for line in used)
    s = clips.ClipStore(spark, str(tmp_path / "c"))
    want = spark.createDataFrame([("a", "one two"), ("a", "one two"), ("b", "three"), (None, "x")], "speaker string, text string")
    assert s.add(want) == 2
    there = os.listdir(tmp_path / "c")
    assert s.add(want) == 0 and os.listdir(tmp_path / "c") == there


def test_equal_audio_is_kept_once_a_file(spark, tmp_path):
    from parley.sources import clips

    s = clips.ClipStore(spark, str(tmp_path / "c"))
    rows = [("a", f"{k} " + "word " * n) for n in range(100, 160) for k in range(20)]
    assert s.add(spark.createDataFrame(rows, "speaker string, text string").coalesce(1)) == len(rows)
    files = list((tmp_path / "c").glob("*/*.parquet"))
    assert sum(f.stat().st_size for f in files) < len(files) * 3e6 and sum(len(r.audio) for r in s.read().collect()) > 45e6


def test_unlike_audio_comes_back_whole(spark, tmp_path):
    import numpy as np

    from parley.operators.synth import hash_text, trim
    from parley.sources import clips, files

    def noise(speaker, text):
        return np.random.default_rng(hash_text(speaker + text)).normal(0, 0.1, 400 * len(text))

    s = clips.ClipStore(spark, str(tmp_path / "c"))
    rows = [(f"s{n % 3}", f"{n}" * (1 + n % 7)) for n in range(300)]
    assert s.add(spark.createDataFrame(rows, "speaker string, text string"), noise) == len(set(rows))
    wav = lambda x: files.wav_bytes(np.clip(trim(x) * 32767, -32768, 32767).astype("<i2").tobytes())
    assert sorted(bytes(r.audio) for r in s.read().collect()) == sorted(wav(noise(*r)) for r in set(rows))

import pytest

from parley.operators import gating as G


def turns(spark, speakers, text="x"):
    rows = [("s", i, s, text) for i, s in enumerate(speakers)]
    return spark.createDataFrame(rows, "sample_id string, turn_idx int, speaker string, text string")


CASES = [
    (120.0, [], "x", "too_few_turns"), (120.0, ["a"], "x", "too_few_turns"), (69.9, list("ababa"), "x", "bypass"), (70.0, list("ababa"), "x", "long"),
    (30.0, list("aaa"), "x", "bypass"), (30.0, list("aaaa"), "x", "collapse"), (45.0, list("ab" * 8)[:15], "x", "bypass"), (45.0, list("ab" * 8), "x", "ping_pong"),
    (45.0, list("aabb" * 4), "x", "bypass"), (45.0, list("ab"), "बहस", "debate"), (45.0, list("ab"), "राय", "bypass"), (45.0, list("ab"), "राय पक्ष", "debate"),
]


@pytest.mark.parametrize("seconds, speakers, text, want", CASES)
def test_gate(spark, seconds, speakers, text, want):
    samples = spark.createDataFrame([("s", seconds)], "sample_id string, duration_seconds double")
    r = G.gate(samples, turns(spark, speakers, text)).head()
    assert r.reason == want and r.triggered == (want not in ("too_few_turns", "bypass"))


def fixed(spark, rows, static=False):
    c = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(rows)], "sample_id string, pos int, turn_id string, speaker string")
    return [r.speaker for r in G.apply_corrections(turns(spark, ["Speaker 0"] * 3), c, static=static).orderBy("turn_idx").collect()]


def test_corrections_are_sparse_and_last_wins(spark):
    assert fixed(spark, [("1", "Speaker 5"), ("1", "spk 7"), ("9", "Speaker 1"), ("0", "Speaker 1"), ("x", "Speaker 1"), ("2", None), (" 3 ", " host ")]) == ["Speaker 7", "Speaker 0", "host"]
    assert fixed(spark, [("true", "Speaker 4"), (None, "Speaker 9"), ("2.9", "Speaker 8")]) == ["Speaker 4", "Speaker 8", "Speaker 0"]
    assert fixed(spark, [("0", "Speaker 4"), ("two", "Speaker 1")], static=True) == ["Speaker 4", "Speaker 0", "Speaker 0"]


def test_route(spark):
    from pyspark.sql import functions as F

    rows = [(60.0, 5.0, False, 1), (60.0, 25.0, True, 2), (220.0, 20.0, True, 3), (301.0, 16.0, False, 3), (700.0, 10.0, True, 2), (100.0, 30.0, True, 2)]
    df = spark.createDataFrame(rows, "s double, o double, t boolean, want int").withColumn("got", G.route(F.col("s"), F.col("o"), F.col("t")))
    assert all(r.got == r.want for r in df.collect())


def stitched(spark, rows):
    df = spark.createDataFrame(rows, "sample_id string, window int, turn_idx int, speaker string")
    return {(r.sample_id, r.window, r.turn_idx): r.speaker for r in G.renamed(df).collect()}


def test_newcomers_never_take_a_name(spark):
    """Window 1 calls the first speaker B and a new one A."""
    got = stitched(spark, [("s", 0, 0, "A"), ("s", 0, 1, "B"), ("s", 0, 2, "A"), ("s", 1, 2, "B"), ("s", 1, 3, "A")])
    assert got == {("s", 0, 0): "A", ("s", 0, 1): "B", ("s", 0, 2): "A", ("s", 1, 2): "A", ("s", 1, 3): "A@1"}


def test_labels_that_look_like_newcomers(spark):
    got = stitched(spark, [("s", 0, 0, "A@1"), ("s", 0, 1, "B"), ("s", 1, 1, "B"), ("s", 1, 2, "A")])
    assert got == {("s", 0, 0): "A@1@0", ("s", 0, 1): "B", ("s", 1, 1): "B", ("s", 1, 2): "A@1"}


def plain_stitch(rows):
    """Window by window, by the best assignment of shared turns."""
    from itertools import permutations

    out, names = {}, {}
    for s in sorted({r[0] for r in rows}):
        for w in range(max(r[1] for r in rows if r[0] == s) + 1):
            own = {t: x for k, v, t, x in rows if (k, v) == (s, w)}
            before = {t: x for k, v, t, x in rows if (k, v) == (s, w - 1)}
            votes = {}
            for t in own.keys() & before.keys():
                votes[own[t], before[t]] = votes.get((own[t], before[t]), 0) + 1
            a, b = sorted({x for x, _ in votes}), sorted({y for _, y in votes})
            b += [None] * max(0, len(a) - len(b))
            best = max(permutations(b, len(a)), key=lambda p: sum(votes.get((x, y), 0) for x, y in zip(a, p, strict=True)), default=())
            back = {x: y for x, y in zip(a, best, strict=True) if (x, y) in votes}
            for x in set(own.values()):
                names[s, w, x] = names[s, w - 1, back[x]] if x in back else (w, x)
        for k, w, t, x in rows:
            if k == s:
                v, label = names[s, w, x]
                out[s, w, t] = label if v == 0 else f"{label}@{v}"
    return out


def test_stitching_against_a_plain_version(spark):
    """Unambiguous votes over many windows: speakers pause, come back and newcomers take their labels."""
    import random

    r = random.Random(3)
    rows = []
    for k in range(12):
        turns = [r.choice("uvwx") for _ in range(r.randint(3, 70))]
        for w in range(max(1, (len(turns) - 5) // 4 + 1)):
            labels = dict(zip("uvwx", r.sample("ABCD", 4), strict=True))
            rows += [(f"s{k}", w, t, labels[turns[t]]) for t in range(4 * w, min(len(turns), 4 * w + 6))]
    got = stitched(spark, rows)
    assert got == plain_stitch(rows)
    per = {}
    for s, w, t, x in rows:
        per.setdefault((s, w), {}).setdefault(got[s, w, t], set()).add(x)
    assert all(len(x) == 1 for names in per.values() for x in names.values())  # no two labels of a window ever meet
    assert max(w for _, w, _, _ in rows) >= 9


def test_one_window_and_none(spark):
    assert stitched(spark, [("s", 0, 0, "A")]) == {("s", 0, 0): "A"}
    assert stitched(spark, []) == {}

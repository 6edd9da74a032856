import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import distance
from parley.functions.assignment import align, best_pairs
from parley.operators import scoring


def w(n, p="w"):
    return " ".join(f"{p}{i}" for i in range(n))


def split(text, *sizes):
    words, out = text.split(), []
    for n in sizes:
        out.append(" ".join(words[:n]))
        words = words[n:]
    return out


A100 = w(100)
GOLDENS = [
    ([("a", "one two three four")], [("x", "one twenty three four")], {"wer": 0.25}),
    ([], [("x", "hello world")], {"wer": 1.0, "cpwer": 1.0, "saa": 0.0}),
    ([("a", "hello world")], [], {"wer": 1.0, "cpwer": 1.0, "saa": 0.0, "gap": 0.0}),
    ([], [], {"wer": 0.0, "cpwer": 0.0, "saa": 1.0}),
    ([("s0", "hello world"), ("s1", "good morning"), ("s0", "how are you")], [("B", "hello world"), ("A", "good morning"), ("B", "how are you")], {"saa": 1.0, "cpwer": 0.0}),
    ([("a", w(4, "a")), ("b", w(4, "b")), ("c", w(4, "c"))], [("x", f"{w(4, 'a')} {w(4, 'b')} {w(4, 'c')}")], {"saa": 4 / 12, "cpwer": 16 / 12}),
    ([("a", w(20, "a")), ("b", w(10, "b")), ("c", w(5, "c"))], [("x", f"{w(20, 'a')} {w(10, 'b')} {w(5, 'c')}")], {"saa": 20 / 35}),
    ([("a", split(A100, 50, 50)[0]), ("b", split(A100, 50, 50)[1])], list(zip("VWXYZ", split(A100, 30, 20, 25, 15, 10), strict=True)), {"saa": 0.55, "cpwer": 0.90}),
    ([("a", A100)], list(zip("WXYZ", split(A100, 25, 25, 25, 25), strict=True)), {"saa": 0.25, "cpwer": 1.50}),
    ([("A", w(3, "a")), ("B", w(3, "b"))], [("X", w(3, "c")), ("Y", w(3, "d"))], {"wer": 1.0, "cpwer": 1.0, "saa": 1.0, "gap": 0.0}),
    ([("a", "p q"), ("b", "r s")], [("x", "p q"), ("y", "r s"), ("z", "t u v")], {"cpwer": 0.75}),
    ([("a", "one")], [("x", w(1000))], {"wer": 1000.0}),
]


@pytest.fixture(scope="module")
def scored(spark):
    turns = lambda k: [(str(i), "h", j, s, t) for i, g in enumerate(GOLDENS) for j, (s, t) in enumerate(g[k])]
    schema = "sample_id string, strategy string, turn_idx int, speaker string, text string"
    ids = spark.createDataFrame([(str(i), "h") for i in range(len(GOLDENS))], "sample_id string, strategy string")
    got = scoring.evaluate(ids, spark.createDataFrame(turns(0), schema).drop("strategy"), spark.createDataFrame(turns(1), schema)).collect()
    return {int(r.sample_id): r.asDict() for r in got}


@pytest.mark.parametrize("i", range(len(GOLDENS)))
def test_goldens(scored, i):
    ref, hyp, want = GOLDENS[i]
    plain = scoring.evaluate_pair(ref, hyp)
    for k, v in want.items():
        assert scored[i][k] == pytest.approx(v), k
        assert plain[k] == pytest.approx(v), k
    assert scored[i]["format_valid"] == bool(hyp)


def test_mapping(scored):
    assert scored[4]["mapping"] == {"B": "s0", "A": "s1"}


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_against_naive(spark):
    r = random.Random(5)
    rows = [([r.choice("abcdefg") for _ in range(r.randint(0, 30))], [r.choice("abcdefg") for _ in range(r.randint(0, 30))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", distance.word_distance(F.col("a"), F.col("b")).alias("d"))
    for x in df.collect():
        assert x.d == naive(x.a, x.b) == distance.edit_distance(x.a, x.b)


def test_character_distance():
    r = random.Random(9)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé日") for _ in range(r.randint(0, 90))) for _ in range(2))
        assert distance.character_distance(a, b) == naive(a, b)


def test_alignment_is_minimal():
    r = random.Random(6)
    for _ in range(100):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 15))] for _ in range(2))
        pairs = align(a, b)
        cost = sum(a[i] != b[j] for i, j in pairs) + len(a) + len(b) - 2 * len(pairs)
        assert cost == naive(a, b)
        assert pairs == sorted(pairs)


def test_assignment_against_enumeration():
    r = np.random.default_rng(7)
    for _ in range(200):
        m, n = r.integers(1, 6, 2)
        a = r.integers(0, 9, (m, n)).astype(float)
        k = max(m, n)
        square = np.zeros((k, k))
        square[:m, :n] = a
        assert best_pairs(a, True)[0] == max(sum(square[i, p] for i, p in enumerate(q)) for q in permutations(range(k)))


def test_random_invariants():
    r = random.Random(8)
    for _ in range(30):
        side = lambda: [(r.choice("abc"), " ".join(r.choice("uvwxyz") for _ in range(r.randint(1, 6)))) for _ in range(r.randint(1, 5))]
        ref, hyp = side(), side()
        s = scoring.evaluate_pair(ref, hyp)
        renamed = scoring.evaluate_pair(ref, [({"a": "Q", "b": "P", "c": "R"}[k], t) for k, t in hyp])
        assert 0 <= s["saa"] <= 1 and s["wer"] >= 0 and s["cpwer"] >= 0
        assert s["gap"] == pytest.approx(max(0, s["cpwer"] - s["wer"]))
        assert renamed["cpwer"] == pytest.approx(s["cpwer"]) and renamed["saa"] == pytest.approx(s["saa"])


def test_bench_times_edited_strategies():
    import bench

    assert {"d14_evaluate", "d14_evaluate_same_words"} <= set(bench.HEADLINE)


def test_alignment_against_the_whole_table():
    import random

    from parley.functions.assignment import align

    def plain(ref, hyp):
        n, m = len(ref), len(hyp)
        t = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(n):
            for j in range(m):
                t[i + 1][j + 1] = min(t[i][j] + (ref[i] != hyp[j]), t[i][j + 1] + 1, t[i + 1][j] + 1)
        out, i, j = [], n, m
        while i and j:
            if t[i][j] == t[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif t[i][j] == t[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    r = random.Random(4)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 30))] for _ in range(2))
        assert align(a, b) == plain(a, b)

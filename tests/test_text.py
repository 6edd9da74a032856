import pytest
from pyspark.sql import functions as F

from parley.functions import text as T

CASES = [
    ("चलो, अब घर चलते हैं!", True, "चलो अब घर चलते हैं"),
    ("कल मीटिंग (meeting) रखी है", False, "कल मीटिंग meeting रखी है"),
    ("कल मीटिंग (meeting) रखी है", True, "कल मीटिंग रखी है"),
    ("well [noise [loud] on the line] go on", True, "well on the line go on"),
    ("a <b c", True, "a b c"),
    ("(one) [two] <three>", True, ""),
    (None, True, ""),
    (" \n\t ", True, ""),
    ("पर\u200dन्तु", True, "परन्तु"),
    ("Tab\there, LINE\nthere", True, "tab here line there"),
    ("cafe\u0301 noir", True, "caf\u00e9 noir"),
    ("\u0928\u093c", True, "\u0929"),
]


@pytest.mark.parametrize("raw, glosses, want", CASES)
def test_normalize(spark, raw, glosses, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(T.normalize(F.col("t"), glosses)).head()[0] == want


def test_decomposed_texts_score_as_composed_ones(spark):
    from parley.operators.scoring import evaluate

    ref = spark.createDataFrame([("a", 0, "S", "caf\u00e9 noir \u0929")], "sample_id string, turn_idx int, speaker string, text string")
    hyp = spark.createDataFrame([("a", 0, "T", "cafe\u0301 noir \u0928\u093c", "x")], "sample_id string, turn_idx int, speaker string, text string, strategy string")
    r = evaluate(hyp.select("sample_id", "strategy"), ref, hyp).head()
    assert (r.wer, r.cer, r.saa, r.cpwer) == (0.0, 0.0, 1.0, 0.0)


def test_compose_only_changes_what_is_decomposed(spark):
    df = spark.createDataFrame([(1, "e\u0301"), (2, "plain"), (3, None), (4, "\u212b")], "i int, t string")
    assert {r.i: r.t for r in T.compose(df, "t").collect()} == {1: "\u00e9", 2: "plain", 3: None, 4: "\u00c5"}
    assert {r.i: r.t for r in df.select("i", T.composed(F.col("t")).alias("t")).collect()} == {1: "\u00e9", 2: "plain", 3: None, 4: "\u00c5"}


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string").select(T.normalize(F.col("t")).alias("t"))
    assert all(r.t == r.u for r in df.select("t", T.normalize(F.col("t")).alias("u")).collect())


def test_slug_and_speaker(spark):
    r = spark.range(1).select(T.model_slug(F.lit("v/some-model-2.5")), T.canonical_speaker(F.lit("spk_07 x")), T.canonical_speaker(F.lit(" host "))).head()
    assert list(r) == ["some_model_2.5", "Speaker 07", "host"]


def test_composition_over_all_code_points(spark):
    import random
    import unicodedata

    assigned = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    marks = [c for c in assigned if unicodedata.combining(c)]
    r = random.Random(1)
    mixed = [r.choice(assigned) + "".join(r.choice(marks) for _ in range(r.randint(1, 4))) + r.choice("áएक가") + r.choice(assigned) for _ in range(20_000)]
    texts = [" ".join(assigned[i : i + 200]) for i in range(0, len(assigned), 200)] + mixed + ["", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.composed(F.col("t")).alias("n")).collect()
    assert all(x.n == (x.t and unicodedata.normalize("NFC", x.t)) for x in got)


def test_normalization_needs_no_python(spark):
    from parley import queries as own

    own.load()
    for name in ("c01_compose", "c07_normalize_documents", "d02_turn_wer", "b01_turn_overlap"):
        plan = own.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name

"""The pipeline's stages: what they drop, what they keep, and the whole against stages run by hand."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import bpe, language_id, packing, substring_dedup, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, DIR)
        if name != "best_fit_packing":
            assert docs.columns == columns
    got = corpus_pipeline.run(spark, DIR)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def plain_run(spark, rows, labels):
    """The pipeline row by row, with all pairs and all windows; only the fitted models are the library's own."""
    toxic = toxicity.learn(docs_of(spark, rows), labels)
    rows = [r for r in rows if 1 / (1 + math.exp(-(toxic.voters.features(r[1]) @ toxic.coef + toxic.bias))) < 0.3]
    lang = language_id.learn(docs_of(spark, rows))
    found = [lang.predict(r[1]) for r in rows]
    rows = [r for r, (name, _, margin, _) in zip(rows, found, strict=True) if name != "und" and margin > 0 and margin >= lang.narrow]

    def shingles(text):  # five words each, as text
        ws = (text or "").encode().lower().split()
        return {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4) if ws else 0)}

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append((r[0] is None, r[0] or 0, i))
    rows = [rows[i] for i in sorted(min(g)[2] for g in groups.values())]

    first, split = {}, [(r[1] or "").encode().split() for r in rows]
    for r, ws in zip(rows, split, strict=True):
        for k in range(len(ws) - 49 if r[0] is not None else 0):
            w = tuple(ws[k : k + 50])
            first[w] = min(first.get(w, r[0]), r[0])
    out = []
    for r, ws in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(ws) - 49 if r[0] is not None else 0):
            if first[tuple(ws[k : k + 50])] < r[0]:
                gone |= set(range(k, k + 50))
        left = b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()
        if not gone or left:
            out.append((r[0], left if gone else r[1]))
    return out


def test_run_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(21)
    english = "the of and to in that was with for they have this from which one would there when what about".split()
    german = "der die und das ist nicht von mit dem auch sich auf eine wird noch nach wie bei oder nur".split()
    word = lambda base: r.choice(base) if r.random() < 0.5 else "".join(r.choice("aeiou" if k % 2 else "bdgklmnrst") for k in range(r.randint(4, 8)))
    text = lambda base, n: " ".join(word(base) for _ in range(n))
    rows = [(i, text(english if i % 3 else german, r.randint(20, 160)), "en" if i % 3 else "de") for i in range(260)]
    rows = [(i, t + (" vile moron idiot scum nasty" if i % 13 == 0 else ""), lang) for i, t, lang in rows]
    passage = text(english, 70)
    rows += [(300 + i, f"{text(english, 60)} {passage} {text(english, 40)}", "en") for i in range(5)] + [(310, passage, "en")]
    rows += [(400 + i, rows[2 * i + 1][1], rows[2 * i + 1][2]) for i in range(20)]  # exact copies
    long = [x for x in rows[:200] if len(x[1].split()) > 120]
    rows += [(500 + i, t.replace(t.split()[60], "changed", 1), lang) for i, (_, t, lang) in enumerate(long[:10])]  # near copies
    rows += [(None, rows[1][1], "en"), (None, text(english, 80), "en"), (None, text(german, 80), "de")]  # no id: a copy and two others
    rows += [(7, text(english, 90), "en"), (8, text(german, 90), "de"), (8, text(german, 90), "de")]  # ids of other texts
    rows += [(600, None, "en"), (601, "", "en"), (602, "12 34", "en"), (603, "x", None)]
    label_rows = [(i, 1, int(i % 13 == 0)) for i in range(0, 260)]
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int")
    docs_of(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = plain_run(spark, rows, labels)
    assert 0 < len(kept) < len(rows) - 40 and {i for i, _ in kept} >= {7, 8, None} and len([i for i, _ in kept if i == 8]) == 3
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    want = Counter()
    for i, t in kept:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, bpe.END_ID]
        for k, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, a, n, zlib.crc32(np.asarray(ids[a : a + n], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want


def similar_pairs(r, n_pairs, low, high):
    """(text, text, similarity) of random texts, the second with some words replaced, at five-word similarities of low to high."""
    out = []
    while len(out) < n_pairs:
        n = r.randint(60, 500)
        ws = [f"w{r.randint(0, 20000)}" for _ in range(n)]
        other = list(ws)
        for _ in range(max(1, int(n * r.uniform(0, 0.1)))):
            other[r.randrange(n)] = f"z{r.randint(0, 10**6)}"
        a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (ws, other))
        if low <= (s := len(a & b) / len(a | b)) < high:
            out.append((" ".join(ws), " ".join(other), s))
    return out


def test_near_duplicates_by_exact_similarity(spark):
    r = random.Random(22)
    pairs = similar_pairs(r, 120, 0.6, 0.8) + similar_pairs(r, 120, 0.8, 0.85) + similar_pairs(r, 60, 0.85, 1.0)
    rows = [(2 * k + x, t, "en") for k, p in enumerate(pairs) for x, t in enumerate(p[:2])]
    kept = {x.doc_id for x in stage("simhash")(spark, docs_of(spark, rows), DIR).collect()}
    assert {i for i, _, _ in rows if i % 2 == 0} <= kept
    assert all(2 * k + 1 in kept for k in range(120))  # below 0.8 nothing goes
    assert sum(2 * k + 1 in kept for k in range(120, 240)) <= 12
    assert sum(2 * k + 1 in kept for k in range(240, 300)) == 0


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """A chain of near copies, and a group of many, over several chunks."""
    from parley.llm import near_copies

    monkeypatch.setattr(near_copies, "MOST_SETS", 16)
    monkeypatch.setattr(near_copies, "MOST_GROUP", 16)
    base = [f"c{i}" for i in range(300)]
    chain = [" ".join(base[k * 10 : k * 10 + 200]) for k in range(8)]  # neighbours share 0.9, the ends nothing like it
    crowd = [" ".join([*base[:150], f"own{k}", *base[150:]]) for k in range(70)]
    rows = [(i, t, "en") for i, t in enumerate(chain + crowd)]
    got = {x.doc_id for x in stage("simhash")(spark, docs_of(spark, rows), DIR).collect()}
    assert got == {0, 8}


def test_near_duplicates_leave_other_columns_alone(spark):
    df = docs_of(spark, [(1, "a b c", "en"), (2, "a b c", "en"), (3, "d", "en"), (3, "d", "en")])
    df = df.withColumns({"row_hash": F.lit("mine"), "n": F.lit(5), "h.h": F.lit(1), "m": F.create_map(F.lit("k"), F.col("doc_id"))})
    got = stage("simhash")(spark, df, DIR)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.row_hash, r.m["k"]) for r in got.collect()) == [(1, "mine", 1), (3, "mine", 3)]


def test_languages_unknown_to_all_rows(spark):
    rows = [(i, f"some english text number {i} with a few words", None) for i in range(30)] + [(40, None, None)]
    assert stage("language_id")(spark, docs_of(spark, rows), DIR).count() == 31


def test_near_duplicates_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "en"), (3, base, "en"), (3, base, "en"), (9, base + " tail", "en"), (7, "other words here entirely", "en"), (None, base, "en"), (11, None, None), (12, "", None)]
    got = stage("simhash")(spark, docs_of(spark, rows), DIR).collect()
    assert sorted(r.doc_id for r in got) == [3, 7, 11]


def test_near_duplicates_without_ids(spark):
    rows = [(None, "alpha beta gamma delta", "en"), (None, "quite another text of words", "en")]
    assert stage("simhash")(spark, docs_of(spark, rows), DIR).count() == 2


def test_near_duplicates_are_judged_row_by_row(spark):
    texts = [" ".join(f"{k}{i}" for i in range(200)) for k in "abcde"]
    a, b, c, d, e = texts
    rows = [(1, a, "en"), (None, a, "en"), (None, b, "en"), (2, c, "en"), (2, d, "en"), (2, d, "en"), (7, d, "en"), (None, e, "en"), (None, e, "en"), (None, e, "de")]
    rows += [(4, "", "en"), (None, None, None)]
    got = sorted((r.doc_id or 0, r.text) for r in stage("simhash")(spark, docs_of(spark, rows), DIR).collect())
    assert got == sorted([(1, a), (0, b), (2, c), (2, d), (0, e), (4, "")])


def test_one_id_with_a_smaller_twin_elsewhere(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(200)) for k in "ab")
    rows = [(1, a, "en"), (5, a, "en"), (5, b, "en")]
    got = sorted((r.doc_id, r.text) for r in stage("simhash")(spark, docs_of(spark, rows), DIR).collect())
    assert got == [(1, a), (5, b)]


def test_passages_go_and_clean_texts_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"start {passage}\n end", "en"), (2, f"own words {passage} more", "en"), (3, passage, "en"), (4, "kept\n as  it is", "en")]
    got = {r.doc_id: r for r in stage("substring_dedup")(spark, docs_of(spark, rows), DIR).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].text == rows[0][1] and got[4].text == "kept\n as  it is"
    assert got[2].text == "own words more" and got[2].n_chars == len("own words more")


def test_filters_keep_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    toxic = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 0").select("doc_id")
    clean = docs.join(toxic, "doc_id", "left_semi")
    kept = stage("toxicity")(spark, docs, "/root/testdata/sf0.01")
    assert kept.join(toxic, "doc_id", "left_semi").count() >= 0.98 * clean.count()
    known = stage("language_id")(spark, docs, "/root/testdata/sf0.01")
    assert known.count() >= 0.98 * docs.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    rows = [(1, None, None), (2, "", "en"), (None, "x y z", None), (3, "a " * 3000, "en"), (3, "a " * 3000, "en"), (4, "12 34", "de")]
    stage(name)(spark, docs_of(spark, rows), DIR).collect()
    assert stage(name)(spark, docs_of(spark, rows).where("false"), DIR).count() == 0


def test_strip_keeps_other_columns(spark):
    df = docs_of(spark, [(1, "a b", "en")]).withColumn("starts", F.lit("mine")).withColumn("tag", F.lit(2))
    assert substring_dedup.strip_repeats(df).head().starts == "mine"
    own = df.withColumns({c: F.lit("mine") for c in ("__d", "__t", "__starts", "__copy")})
    got = substring_dedup.strip_repeats(own)
    assert got.columns == own.columns and got.head()[-4:] == ("mine",) * 4


def test_near_duplicates_meet_by_the_pigeonhole(spark, monkeypatch):
    """Where no band of least hashes meets, op7's pigeonhole finds fingerprints within three bits; the sets still decide."""
    from parley.llm import near_copies

    text = [f"w{i}" for i in range(3000)]
    copies = [" ".join([*text[:k], "changed", *text[k + 1 :]]) for k in (500, 1500, 2500)]
    rows = [(1, " ".join(text)), *enumerate(copies, 2), (9, " ".join(f"v{i}" for i in range(3000)))]
    monkeypatch.setattr(near_copies, "loose_links", lambda keyed, hot, *more: spark.createDataFrame([], "a long, b long"))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 9]
    far = near_copies.keep_one(spark.createDataFrame([rows[0], rows[1]], "doc_id long, text string"), similarity=0.9999)
    assert far.count() == 2

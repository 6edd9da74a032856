"""URL filters, importance resampling and token alignment against brute force and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import bpe, importance, token_alignment, url_filter
from parley.llm.common import Workspace

DIR = "/root/testdata/sf0.001"
SPAM = ("free-bets", "ads-track", "cheap-pills", "spam-farm", "adult-x", "casino-win")


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.learn(spark.createDataFrame(url_filter.default_labels(), "url string, label int"))


# URL filters


def plain_rule(url, rules=url_filter.RULES):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, None)))


URLS = [
    None, "", "x", "http://", "http://com/", "https://a.com", "https://a.com?x=/", "HTTPS://WWW.Example.COM/en/A?q#f", "https://example.com/en/", "https://example.com/EN/", "https://xexample.com/en/",
    "https://m.www.example.com/en/x", "ftp://b.net/es/#t", "b.net/fr/", "http://b.net/fr", "http://net/fr/://x/es/", "http://é.net/es/\n/x", "http://a..com/", "http://a.com./x", "http://u@a.com:80/x", "http://a.net/fr/" + "y" * 50_000,
]


def test_rules_and_parts(spark, model):
    df = spark.createDataFrame([(i, u, "r", "h", "v") for i, u in enumerate(URLS)] + [(None, "http://a.net/es/", "r", "h", "v"), (1, "", "r", "h", "v")], "page_id long, url string, rule string, host string, verdict string")
    rows = url_filter.judge(df, model).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, rule, verdict = plain_rule(URLS[r.page_id] if r.page_id is not None else "http://a.net/es/")
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    kept = url_filter.keep_allowed(df, model)
    assert kept.columns == df.columns
    verdicts = {URLS[r.page_id]: r.verdict for r in rows if r.page_id is not None} | {"http://a.net/es/": "block", "": "allow"}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if verdicts[r.url] == "allow")


def test_rules_in_sql(spark, model):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    want = duckdb.sql(
        rf"""WITH p AS (SELECT page_id, split_part(url, '://', 1) AS scheme, substr(url, strpos(url, '://') + 3) AS rest FROM '{DIR}/pages.parquet'),
        q AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r AS (SELECT page_id, arg_max(h || s, strlen(h || s)) AS rule, arg_max(v, strlen(h || s)) AS verdict FROM q, (VALUES {values}) t(v, h, s)
              WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
        SELECT page_id, host, path, rule, verdict FROM q LEFT JOIN r USING (page_id)"""
    ).fetchall()
    got = url_filter.judge(pages, model).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in got) == sorted(w[:4] for w in want)
    verdicts = {r.page_id: r.verdict for r in got}
    assert all(verdicts[w[0]] == w[4] for w in want if w[3])


def test_no_rules_and_too_many(spark, model):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(df, model, rules=[]).head().rule is None
    with pytest.raises(ValueError):
        url_filter.judge(df, model, rules=[("block", f"h{i}", "/") for i in range(url_filter.MOST_RULES + 1)])


def test_model_tells_unwanted_hosts(spark, model):
    rows = url_filter.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), model).collect()
    hits = [(any(s in r.host for s in SPAM), r.score >= 0.5) for r in rows]
    unwanted, wanted = [p for s, p in hits if s], [p for s, p in hits if not s]
    assert unwanted and sum(unwanted) >= 0.95 * len(unwanted)
    assert sum(wanted) <= 0.01 * len(wanted)


def test_held_out_labels():
    labels = url_filter.default_labels()
    parts = [plain_rule(u)[:2] for u, _ in labels]
    y = np.array([v for _, v in labels])
    fold = np.random.default_rng(0).integers(0, 8, len(y))
    right = 0
    for f in range(8):
        inn, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        m = url_filter.fit([parts[i][0].encode() for i in inn], [parts[i][1].encode() for i in inn], y[inn])
        right += ((m.score([parts[i][0].encode() for i in out], [parts[i][1].encode() for i in out]) >= 0.5) == y[out]).sum()
    assert right / len(y) >= 0.75  # half of them by chance


def test_learning_from_few(spark):
    none = url_filter.learn(spark.createDataFrame([], "url string, label int"))
    one = url_filter.learn(spark.createDataFrame([("http://a.b/c", 1), (None, 0), ("http://x", None)], "url string, label int"))
    assert none.score([b"a"], [b""])[0] < 0.01 and one.score([b"a"], [b""])[0] > 0.99
    many = spark.range(5000).selectExpr("concat('http://', if(id % 2 = 0, 'good', 'bad'), id, '.test/') AS url", "cast(id % 2 AS int) AS label")
    m = url_filter.learn(many, most=500)
    assert m.score([b"bad77.test"], [b"/"])[0] > 0.5 > m.score([b"good78.test"], [b"/"])[0]


def test_grams_of_one_text():
    row, bucket = url_filter.grams([b"abc", b"", b"abc"], 1, orders=(3,), buckets=1 << 30)
    assert row.tolist() == [0, 0, 0, 2, 2, 2] and bucket[:3].tolist() == bucket[3:].tolist() and len(set(bucket[:3].tolist())) == 3
    assert not len(url_filter.grams([b"", b""], 1)[0]) and not len(url_filter.grams([], 1)[0])


def test_no_pages(spark, model):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


# importance resampling


def plain_resample(docs, target, least, most, percent=10, least_words=20):
    upper = str.maketrans(importance.UPPER, importance.LOWER)

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(grams(x)[1])
    for x in target:
        t.update(grams(x)[1])
    up, down = s.total() + 10000, t.total() + 10000
    rows = []
    for d, x in docs:
        n, f = grams(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * up / ((s[b] + 1) * down))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def awkward_texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["É", "日本", "Straße", "ÀB", "a1", "Z"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 19, 20, 21, 60])))) for i in range(400)]
    return rows + [(None, "w1 " * 25), (None, None), (5, rows[7][1]), (5, rows[7][1]), (401, None), (402, ""), (403, ". , !"), (404, "W1-w2_w3\tw4\n" * 9000)]


@pytest.mark.parametrize("least, most", [(1, 1), (1, 3), (2, 2)])
def test_resampling_against_plain(spark, least, most):
    docs, target = awkward_texts(), ["w1 w2 w3 w4 É 日本", None, "w5 w6 " * 50]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in docs], "doc_id long, text string, word string, bucket string, rank int").repartition(3)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), least=least, most=most)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target, least, most)


def test_resampling_in_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = db.execute(importance.oracle())
    names = [d[0] for d in cur.description]
    got = importance.resample(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet"))
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_ranks_over_many_parts(spark, monkeypatch):
    """Equal scores by the thousand, dealt over many ranges."""
    monkeypatch.setattr(importance, "ROWS_A_PART", 150)
    rows = [(i % 1500 if i % 7 else None, 20 + i % 2 - (i % 5 == 0) * 5, 10, 0, (i % 3) * (i % 4 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(5)
    got = importance.draw(df, Workspace(spark, "test"), percent=50).collect()
    drawn = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    want = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    want = want[: len(want) // 2]
    assert len(got) == len(rows) and [r.rank for r in drawn] == list(range(1, len(want) + 1))
    assert [(r.doc_id, r.score) for r in drawn] == [(w[0], w[4]) for w in want]


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    assert [tuple(r) for r in importance.resample(docs, none).collect()] == plain_resample([(1, "a b")], [], 1, 1)
    with pytest.raises(ValueError):
        importance.features(importance.position_table(docs, key=["doc_id"], text_col="text"), key=["doc_id"], least=2, most=1)


# token alignment


def plain_alignment(rows):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.vocabulary_path())
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: k for k, c in bpe._SHOWN.items()}
    made, counts = [], Counter()
    for d, text in rows:
        links, groups, sides = [], [], ({}, {})
        if text:
            got = a.encode(" " + text, add_special_tokens=False)
            tokens_a = [(i, bytes(byte[c] for c in t)) for i, t in zip(got.ids, got.tokens, strict=True)]
            tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in tokens_a) == (" " + text).encode() == b"".join(x for _, x in tokens_b):
                for side, tokens in zip(sides, (tokens_a, tokens_b), strict=True):
                    end = 0
                    for i, x in tokens:
                        end += len(x)
                        side[end] = i
                held = ([], [])
                for end in sorted(set(sides[0]) | set(sides[1])):
                    for side, own in zip(sides, held, strict=True):
                        if end in side:
                            own.append(str(side[end]))
                    if end in sides[0] and end in sides[1]:
                        groups.append("|".join(",".join(h) for h in held))
                        held = ([], [])
                        links.append((sides[0][end], sides[1][end]))
        counts.update(links)
        made.append((d, len(sides[0]), len(sides[1]), groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(((d, na, nb, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for d, na, nb, g, ls in made), key=repr)


def alignment_texts(n):
    r = random.Random(5)
    parts = [*"ab cd  \n\t.,'1289éß日本🎉▁\x00<>| 　", "<|endoftext|>", "</s>", "<0x41>", " the", " Hello", "\r\n", "...", "don't"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.choice([1, 2, 5, 30, 200])))) for i in range(n)]
    return rows + [(None, None), (1, ""), (1, " "), (1, "same"), (1, "same"), (None, "x" * 5000), (3, "日本" * 3000), (4, "ab cd, " * 9000), (5, "▁"), (6, "x" * 70_000 + " end")]


@pytest.mark.parametrize("window, broadcast", [(1 << 16, 1 << 20), (50, 1 << 20), (1 << 16, 0)])
def test_alignment_against_plain(spark, monkeypatch, window, broadcast):
    monkeypatch.setattr(token_alignment, "MOST_BROADCAST", broadcast)
    rows = alignment_texts(600)
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, row int, side string, n long").repartition(3)
    assert sorted(map(tuple, token_alignment.align(df, window=window).collect()), key=repr) == plain_alignment(rows)


def test_alignment_of_documents(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_alignment.align(df).collect()), key=repr) == plain_alignment(rows)


def test_alignment_of_nothing(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert token_alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_a_group_over_many_windows():
    """Sides that meet only at the end leave one group, whatever the windows."""
    sizes = (np.array([0, 3]), np.array([0, 2]))
    m = token_alignment.Machine(sizes, token_alignment._Digits(2))
    for _ in range(2):
        m.take(np.array([1], np.uint32), np.empty(0, np.uint32))
        m.take(np.empty(0, np.uint32), np.array([1], np.uint32))
    m.take(np.empty(0, np.uint32), np.array([1], np.uint32))
    assert m.result()[:4] == (2, 3, 1, 1) and m.result()[4] == hashlib.sha256(b"1,1|1,1,1").hexdigest()


def test_counted_links(spark):
    df = spark.createDataFrame([([(7 << 32) | 1] * 3 + [(7 << 32) | 2] * 3 + [(8 << 32) | 1],), ([(7 << 32) | 3],), ([],)], "pairs array<long>")
    got = {(r.pair >> 32, r.pair & 0xFFFFFFFF): (r.n, r.best) for r in token_alignment.pair_counts(df).collect()}
    assert got == {(7, 1): (3, True), (7, 2): (3, True), (7, 3): (1, False), (8, 1): (1, True)}
    assert df.select(F.size("pairs")).count() == 3

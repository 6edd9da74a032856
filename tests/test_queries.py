"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from parley import queries as own

own.load()
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(columns, data):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_against_sql(spark, db, name):
    df = own.QUERIES[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(own.ORACLES[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_runs(spark, name):
    assert own.QUERIES[name](spark, DIR).count() > 0


def test_edited_scores_against_plain(spark):
    from parley.operators.scoring import evaluate_pair
    from parley.queries.scoring import d14_evaluate
    from parley.sources import views

    side = {}
    for r in views.turns(spark, DIR).orderBy("sample_id", "turn_idx").collect():
        side.setdefault((r.sample_id, None), []).append((r.speaker, " ".join(r.words)))
    for r in views.hypotheses(spark, DIR).orderBy("sample_id", "turn_idx").collect():
        side.setdefault((r.sample_id, r.strategy), []).append((r.speaker, " ".join(r.words)))
    for r in d14_evaluate(spark, DIR).where("strategy <> 'labels' and sample_id < 6").collect():
        want = evaluate_pair(side[r.sample_id, None], side[r.sample_id, r.strategy])
        assert all(r[k] == pytest.approx(v) for k, v in want.items()), (r, want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(DIR)

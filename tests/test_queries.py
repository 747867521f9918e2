"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from turnloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return "null" if v is None else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ran = db.execute(ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in ran.fetchall()]
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())

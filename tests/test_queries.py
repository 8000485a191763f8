"""Every registered query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from tickloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
SLOW = {"walk_forward_predictions", "walk_forward_boosted", "feature_importance", "model_leaderboard", "parameter_grid", "latest_model_signal", "best_model_signal", "symbol_model_predictions"}


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == SLOW | {"bootstrap_ci"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1 and set(QUERIES) <= set(e.queries())

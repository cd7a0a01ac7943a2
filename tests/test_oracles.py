"""Every query that has SQL gives the rows of that SQL; the others run and keep their schema."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from millrace import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 6))
    if isinstance(x, dict):
        return str(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return str(x)


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in at], sorted(tuple(plain(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    found = ordered(df.collect(), df.columns)
    cursor = duck.execute(catalog.ORACLES[name])
    wanted = ordered(cursor.fetchall(), [d[0] for d in cursor.description])
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() >= 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)

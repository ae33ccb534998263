"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import canvass.model_queries  # noqa: F401  registers its queries
from canvass.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return str(v)
    try:
        return "nan" if math.isnan(v) else repr(round(float(v), 8) + 0.0)
    except TypeError:
        return str(v)


def rows(names, found):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows_with_values(spark, name):
    got = QUERIES[name](spark, SF)
    found = got.collect()
    assert found and len(set(got.columns)) == len(got.columns)
    for c in got.columns:
        values = [r[c] for r in found if r[c] is not None]
        assert values, f"{c} is null everywhere"
        assert not [v for v in values if isinstance(v, float) and math.isnan(v)], f"{c} has NaN"

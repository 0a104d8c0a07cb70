"""Every registered query with SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from millrace.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(str(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    got = duck.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    assert ours == sorted(str(tuple(norm(r[k]) for k in at)) for r in got.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())

"""Every registered query of the reference's operators against its SQL, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from docaudit.plans import audits, catalogue, forms, planted  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


def canonical(rows, names):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6)) if isinstance(v, int | float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, db, name):
    got = catalogue.queries()[name](spark, DATA)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())

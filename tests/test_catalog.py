"""Every relational query against its SQL."""

import math

import duckdb
import pytest

from strandlake.plans import catalog, checks_catalog, extract_catalog, periodic_catalog, reports_catalog, validation_catalog  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF)
    want = oracle.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())

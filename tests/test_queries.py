"""Every registered query against its SQL, or for rows where there is none."""

import pytest

from verify import compare
from vulnwave.catalog import ORACLES, QUERIES


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert compare(got, want) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())

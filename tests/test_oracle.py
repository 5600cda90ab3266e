"""Every query of the core that SQL can express, against DuckDB over whole tables."""

import pytest
from conftest import against_sql

from shelfspark.catalog import commands, formats, problems, quality, relational, rest, search, structured

PARTS = [problems, structured, relational, quality, search, formats, rest, commands]
PAIRS = [(n, p.QUERIES[n], p.SQL[n]) for p in PARTS for n in p.QUERIES if n in p.SQL]
REST = [(n, p.QUERIES[n]) for p in PARTS for n in p.QUERIES if n not in p.SQL]


@pytest.mark.parametrize("name,run,sql", PAIRS, ids=[x[0] for x in PAIRS])
def test_against_sql(spark, data, name, run, sql):
    against_sql(spark, data, run, sql)


@pytest.mark.parametrize("name,run", REST, ids=[x[0] for x in REST])
def test_runs(spark, data, name, run):
    df = run(spark, data)
    assert df.columns and len(df.collect()) > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names)

import pytest
from conftest import against_sql

from shelfspark.llm import queries as Q

PAIRS = [(n, f, Q.SQL[n]) for n, f in Q.QUERIES.items() if n in Q.SQL]
REST = [(n, f) for n, f in Q.QUERIES.items() if n not in Q.SQL]


@pytest.mark.parametrize("name,run,sql", PAIRS, ids=[x[0] for x in PAIRS])
def test_against_sql(spark, data, name, run, sql):
    against_sql(spark, data, run, sql)


@pytest.mark.parametrize("name,run", REST, ids=[x[0] for x in REST])
def test_runs(spark, data, name, run):
    assert len(run(spark, data).collect()) > 0


def test_nothing_outside_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(Q.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p

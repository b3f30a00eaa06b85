"""The subpackage's queries against their SQL twins and, where there is none, that they run."""

import os

import pytest

from tests.test_queries import DATA, compare, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_sql_twins(spark, duck):  # noqa: F811
    from gleanstone.llm import queries

    compare(spark, duck, [queries])


def test_queries_without_twin_run(spark):
    from gleanstone.llm import queries

    for name, query in queries.QUERIES.items():
        if name not in queries.ORACLES:
            rows = query(spark, DATA).collect()
            assert len(rows) == len({repr(r) for r in rows}) or not name.endswith("_found"), name

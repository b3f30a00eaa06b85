"""The registered queries against their SQL twins on the smallest tables."""

import glob
import os
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, duck, modules):
    queries = {name: query for module in modules for name, query in module.QUERIES.items()}
    for module in modules:
        for name, sql in module.ORACLES.items():
            df = queries[name](spark, DATA)
            names = sorted(df.columns)
            got = Counter(tuple(repr(plain(r[n])) for n in names) for r in df.collect())
            result = duck.execute(sql)
            columns = [c[0] for c in result.description]
            assert sorted(columns) == names, name
            want = Counter(tuple(repr(plain(r[columns.index(n)])) for n in names) for r in result.fetchall())
            assert got == want, name


def test_sql_twins(spark, duck):
    from gleanstone.plans import problems, reference, stages

    compare(spark, duck, [problems, reference, stages])


def test_queries_without_twin_run(spark):
    """Every registered query without a twin is run to its end; rows of pN_found are distinct."""
    import __spark_entry__ as entry
    from gleanstone.plans import problems, reference, stages

    twins = entry.oracle_sql()
    for module in (problems, reference, stages):
        for name, query in module.QUERIES.items():
            if name not in twins:
                rows = query(spark, DATA).collect()
                assert rows and (len(rows) == len({repr(r) for r in rows}) or not name.endswith("_found")), name

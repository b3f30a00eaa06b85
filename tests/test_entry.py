import importlib
import sys


def test_entry_points(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {"p3_found", "p7_found"} <= set(queries)


def test_the_rest_stands_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("gleanstone.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "gleanstone.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert not any(q.startswith("p1_") for q in entry.queries()) and "p3_found" in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")

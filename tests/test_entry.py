import os

import pytest

DATA = "/root/testdata/sf0.001"


def plain(v):
    """A value as both sides show it: floats to six digits, structs and lists as tuples."""
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def table(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.fixture(scope="module")
def db():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return db


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_match_sql(spark, db):
    from brindle.plans import suites

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    wrong = []
    for name, sql in suites.oracle_sql().items():
        got = suites.queries()[name](spark, DATA)
        found = db.execute(sql)
        names, kinds = [c[0] for c in found.description], [str(c[1]) for c in found.description]
        assert sorted(got.columns) == sorted(names), name
        if table(got.select(*[f"`{c}`" for c in names]).collect()) != table(found.fetchall()):
            wrong.append(name)
        for c, kind in zip(names, kinds, strict=True):
            own = got.schema[c].dataType.simpleString()
            if own in KINDS and kind != KINDS[own]:
                wrong.append((name, c, own, kind))
    assert not wrong


def test_entry_imports_without_subpackage(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def refuse(name, *a, **k):
        if name == "brindle.llm" or name.startswith("brindle.llm.") or (name == "brindle.llm" and a):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("brindle.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", refuse)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert entry.llm is None and "pricing_summary" in entry.queries() and "op1_quality_rules" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")

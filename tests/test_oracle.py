"""Every query with SQL agrees with it on the smallest tables; every other one runs."""

import math

import duckdb
import pytest

from tessera import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in ("documents", "part", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'" if not __import__("os").path.isdir(f"{SF}/{t}.parquet") else f"create view {t} as select * from '{SF}/{t}.parquet/*.parquet'")
    return con


def plain(v):
    return v if v is None or isinstance(v, (bool, str)) else round(float(v), 6)


@pytest.mark.parametrize("name", [n for n in Q.CATALOGUE if n != "train_classifier"])
def test_query(spark, base, name):
    run, sql = Q.CATALOGUE[name]
    df = run(spark, SF)
    cols = sorted(df.columns)
    rows = df.collect()
    if sql is None:
        assert rows is not None
        return
    rel = base.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert len(cols) == len(rel.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_imports_without_the_corpus_parts(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("tessera.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    names = entry.queries()
    assert "linkage" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)

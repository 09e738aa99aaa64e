"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from marlstone.plans import registry
from marlstone.session import TABLES

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return None
        if isinstance(v, bool) or str(v) in ("True", "False"):
            return str(v)
        return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" else str(v)

    out = [tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p))) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_subpackage():
    root = Path(__file__).resolve().parents[1] / "marlstone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "marlstone.llm" not in p.read_text(), p

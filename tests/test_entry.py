"""The catalog runs as a whole, and agrees with SQL, on the smallest tables there are."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
duckdb = pytest.importorskip("duckdb")


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "value"]


def test_catalog_does_not_need_llm():
    import ast

    for f in Path(entry.__file__).parent.joinpath("deltarill").rglob("*.py"):
        if "llm" not in f.parts:
            names = [n for x in ast.walk(ast.parse(f.read_text())) if isinstance(x, (ast.Import, ast.ImportFrom)) for n in ([x.module or ""] if isinstance(x, ast.ImportFrom) else [a.name for a in x.names])]
            assert not any("llm" in n for n in names), f


@pytest.mark.parametrize("name", sorted(k for k, f in entry.queries().items() if "llm" not in f.__module__))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    if name in entry.oracle_sql():
        cur = sql.execute(entry.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
        assert got == want
    else:
        assert got

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
duckdb = pytest.importorskip("duckdb")

OWN = sorted(k for k, f in entry.queries().items() if "llm" in f.__module__)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr(list(map(str, r))) for r in df.select(*cols).collect())
    assert got or name == "p7_found"
    if name in entry.oracle_sql():
        c = duckdb.connect()
        for f in DATA.glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        cur = c.execute(entry.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert got == sorted(repr([str(r[names.index(x)]) for x in cols]) for r in cur.fetchall())

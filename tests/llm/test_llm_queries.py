import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from storyloom.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    order = [[x[0] for x in cur.description].index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in cur.fetchall())

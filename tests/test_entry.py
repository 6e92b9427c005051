import glob
import os

import pytest

import __spark_entry__ as entry


def test_contract(spark, tiny):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(k for m in entry.MODULES if "llm" not in m.__name__ for k in m.QUERIES))
def test_query(spark, tiny, name):
    import duckdb

    rows = entry.queries()[name](spark, tiny)
    got = sorted(rows.columns)
    data = rows.collect()
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    c = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == got
    norm = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted((tuple(norm(r[names.index(k)]) for k in got) for r in c.fetchall()), key=str)
    assert sorted((tuple(norm(r[k]) for k in got) for r in data), key=str) == want

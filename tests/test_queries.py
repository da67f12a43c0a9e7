import re

import duckdb
import pytest

import __spark_entry__ as entry
from verify_sql import rows

SF = "/root/testdata/sf0.001"
CORE = {n: f for n, f in entry.queries().items() if not re.match(r"p\d_", n)}


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        assert got == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1

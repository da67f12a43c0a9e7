import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify_sql import rows

SF = "/root/testdata/sf0.001"
OWN = {n: f for n, f in entry.queries().items() if re.match(r"p\d_", n)}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, name):
    df = OWN[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert all(n == 1 for n in got.values())
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = con.execute(entry.oracle_sql()[name])
        assert got == rows([d[0] for d in cur.description], cur.fetchall())

import os
import time

import duckdb
import pytest

from tidemark.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as from '{SF}/{t}'")
    began = time.time()
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert time.time() - began < 120
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)

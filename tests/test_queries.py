import math
import os

import duckdb
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.001"


def cell(v):
    if isinstance(v, float):
        return float(f"{v:.10g}") if math.isfinite(v) else str(v)
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = rows_of(df.collect(), df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(cur.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(registry.queries()) <= set(e.queries())


def test_whole_tables(spark, con):
    """The queries on id ranges have one beside them over the whole table."""
    q = registry.queries()
    orders, events = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "events"))
    assert sorted(int(k) for r in q["merge_sort_all"](spark, SF).collect() for k in r.in_order.split(",")) == sorted(r[0] for r in orders.select("o_orderkey").collect())
    assert {r.k for r in q["l0_arbitration_all"](spark, SF).collect()} == {r[0] for r in events.select("user_id").distinct().collect()}
    action = {}
    for r in orders.collect():
        action.setdefault(r.o_custkey * 7 + r.o_orderkey % 7, set()).add(r.o_orderstatus)
    want = {("add", k) for k, v in action.items() if v == {"O"}} | {("del", k) for k, v in action.items() if v == {"F"}}
    assert {(r.action, r.num) for r in q["version_delta_all"](spark, SF).collect()} == want and len(want) > 100


def test_whole_orders(spark):
    q = registry.queries()
    for name, table, n in (("user_key_order_all", "customer", "place"), ("ordered_encoding_all", "orders", "n")):
        count = spark.read.parquet(f"{SF}/{table}.parquet").count()
        assert sorted(r[n] for r in q[name](spark, SF).collect()) == list(range(1, count + 1))

import math
import random

import duckdb
import pytest

from tidemark.llm import topk


def slow(rows, queries, k=5, scale=256):
    ints = lambda v: [math.floor(max(-(2.0**62), min(2.0**62, scale * x))) for x in v]
    good = {(i, tuple(ints(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in good:
        if q in queries:
            found = sorted({(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), c) for c, w in good if c != q and len(w) == len(v)})
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(found[:k], 1)}
    return out


def run(spark, rows, queries):
    t = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int")
    return {tuple(r) for r in topk.top_k(t, t.where(topk.F.col("vec_id").isin(queries))).collect()}


@pytest.mark.parametrize("size", [0.5, 3.0, 1e5, 1e6, 5e6, 1e300])
def test_random(spark, size):
    pick = random.Random(3)
    rows = [(i, [pick.choice([pick.uniform(-size, size), 0.0]) for _ in range(7)]) for i in range(300)]
    assert run(spark, rows, list(range(0, 300, 30))) == slow(rows, set(range(0, 300, 30)))


def test_edges(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    same = [(i, [0.5, -0.5]) for i in range(100, 160)]
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [9.0, 9.0]), (5, [1.0]), (6, [2.0]), (7, []), (8, []), (9, [1.0, 2.0, 3.0]), *same]
    asked = [0, 1, 2, 3, 4, 5, 7, 9, 100, 130, 159]
    want = {r for r in slow(rows, set(asked))}
    assert run(spark, rows, asked) == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    assert run(spark, rows, asked) == want
    assert run(spark, [], asked) == set() and run(spark, rows, [-1]) == set()


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = {tuple(r) for r in topk.op4_topk(spark, sf).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{sf}/embeddings.parquet'")
    assert got == set(con.execute(topk.ORACLE).fetchall()) and len(got) == 50


@pytest.mark.parametrize("size", [1.0, 5e6, 1e300])
def test_many_copies(spark, size):
    pick = random.Random(5)
    rows = [(i, [pick.uniform(-size, size) for _ in range(6)]) for i in range(120)]
    top = [size] * 6
    rows += [(500, top)] * 400 + [(501, top)] * 30 + [(500, [size, 0.0, 0.0, 0.0, 0.0, 0.0])] * 20 + [(r[0], r[1]) for r in rows[:9] for _ in range(40)]
    asked = [0, 7, 60, 90, 501]
    want = slow(rows, set(asked))
    assert run(spark, rows, asked) == want and len(want) >= 25


def by_sql(rows, every=True):
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", [list(r) for r in rows])
    return sorted(con.execute(topk.ORACLE).fetchall())


def every_row(spark, rows):
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in topk.top_k(t, t.where("vec_id % 50 = 0"), every_row=True, saturate=False).collect())


def test_repeated_rows_against_sql(spark):
    pick = random.Random(6)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0])]
    assert every_row(spark, rows) == by_sql(rows) and len(by_sql(rows)) == 4
    rows = [(i % 130, [pick.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(400)]
    rows += [(50, [2.0, 2.0, 2.0])] * 30 + [(7, [2.0, 2.0, 2.0])] * 3 + [(100, [2.0, 2.0, 2.0])] * 2 + [(50, [0.5, 2.0, 2.0])] * 2 + [(k, [0.5, 0.5, 0.5]) for k in range(200, 400)]
    assert every_row(spark, rows) == by_sql(rows)


def test_too_large_is_an_error(spark):
    for rows in ([(0, [1e300]), (1, [1.0])], [(0, [1e16, 1e16]), (1, [1e16, 1e16])]):
        with pytest.raises(Exception, match="2\\*\\*62|64 bits"):
            every_row(spark, rows)


def test_few_exact_vectors_are_read(spark, tmp_path):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = f"file://{tmp_path}/va"
    topk.write_file(topk.quantised(t, "vec_id", "embedding", 256, False), path, 5, True)
    asked = topk.quantised(t.where("vec_id % 50 = 0"), "vec_id", "embedding", 256, False).withColumn("qn", topk.F.monotonically_increasing_id()).select("qn", "id", "v")
    left = topk.candidates(spark, path, asked, 5, True)
    assert left.count() < 12 * asked.count() and left.select("rid").distinct().count() < t.count() / 4

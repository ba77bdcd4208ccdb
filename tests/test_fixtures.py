"""Small fixtures with known answers."""

import random

from pyspark.sql import functions as F

from tidemark.operators import reads
from tidemark.operators.reads import ChangeLog


def test_find_ge(spark):
    rows = [(f"key-{i:x}", i + 1, 1, f"value-{i:x}") for i in range(10)]
    log = ChangeLog(spark.createDataFrame(rows, "ukey string, seq long, kt int, value string"))
    for probe, want in {"key-55": "key-6", "key-71": "key-8", "key-23": "key-3", "key-77": "key-8", "key-11": "key-2", "key-1": "key-1"}.items():
        assert log.find_ge(probe).first()["ukey"] == want
    assert log.find_ge("key-a").first() is None


def test_binary_search(spark):
    df = spark.createDataFrame([(p,) for p in (4, 12, 3, -5)], "p int").select("p", reads.binary_search(F.array(*map(F.lit, (1, 3, 5, 7, 9))), F.col("p")).alias("i"))
    assert {r.p: r.i for r in df.collect()} == {4: -3, 12: -6, 3: 1, -5: -1}


def test_sort(spark):
    assert spark.createDataFrame([([4, 9, 7, 2, 5],)], "a array<int>").select(F.sort_array("a").alias("a")).first()["a"] == [2, 4, 5, 7, 9]
    values = [random.Random(1).randrange(1 << 32) for _ in range(100_000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r.v for r in reads.top_k(df, [F.desc("v")], 500).collect()] == sorted(values, reverse=True)[:500]


def test_sequence_numbers_follow_the_order(spark):
    values = random.Random(2).sample(range(10**6), 3000)
    got = reads.assign_sequence(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), ["v"], 10).collect()
    assert sorted((r.v, r.seq) for r in got) == [(v, 11 + i) for i, v in enumerate(sorted(values))]
    assert reads.assign_sequence(spark.createDataFrame([], "v long"), ["v"], 0).count() == 0


def test_versions_edges(spark):
    """Put only, overwrite, delete last, delete then put, delete of a missing key, empty value, empty key, prefixes, high bytes."""
    h = [(b"a", 1, 1, b"x"), (b"ab", 2, 1, b""), (b"a", 3, 1, b"y"), (b"ab", 4, 2, None), (b"", 5, 1, b"e"), (b"zz", 6, 2, None), (b"\x80", 7, 1, b"h"), (b"ab", 8, 1, b"back"), (b"a", 9, 2, None)]
    df = spark.createDataFrame([(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in h], "ukey binary, seq long, kt byte, value binary")
    for at in range(11):
        want = {}
        for k, s, t, v in h:
            if s <= at:
                want[k] = v if t == 1 else None
        got = {bytes(r.ukey): bytes(r.value) for r in ChangeLog(df).live(at).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}


def test_assigned_sequence_keeps_nulls(spark):
    rows = [(v, w) for w, v in enumerate([5, None, 3, None, 9, 1, None, 3])]
    got = reads.assign_sequence(spark.createDataFrame(rows, "v long, w long").repartition(3), ["v", "w"], 10).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert sorted((r.seq, r.v, r.w) for r in got) == [(11 + i, *r) for i, r in enumerate(ordered)]
    none = reads.assign_sequence(spark.createDataFrame([(None,), (None,)], "v long"), ["v"], 0).collect()
    assert sorted(r.seq for r in none) == [1, 2]


def test_assigned_sequence_of_strings(spark):
    names = [f"{w}{i}" for i in range(300) for w in ("a", "é", "Z", "")] + [None]
    for kind, value in (("string", lambda n: n), ("binary", lambda n: None if n is None else n.encode())):
        got = reads.assign_sequence(spark.createDataFrame([(value(n),) for n in names], f"v {kind}").repartition(5), ["v"], 0).collect()
        want = [*sorted(n.encode() for n in names if n is not None), None]
        assert [None if r.v is None else bytes(r.v) if kind == "binary" else r.v.encode() for r in sorted(got, key=lambda r: r.seq)] == want

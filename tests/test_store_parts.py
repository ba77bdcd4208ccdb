import random
import zlib

import pytest

from tidemark.errors import BatchHeaderError, Corrupted
from tidemark.functions import bloom, keys
from tidemark.options import DELETE, PUT, Options
from tidemark.plans.manifest import Edit, File, Version, back_pressure, closure, pick
from tidemark.sources import journal, tablefile


def test_internal_keys(spark):
    rows = [(b"", 0, 1), (b"k\x00\xff", keys.MAX_SEQ, 2), (b"abc", 1 << 55, 1), (b"x" * 40, 77, 2)]
    df = spark.createDataFrame([(bytearray(k), s, t) for k, s, t in rows], "k binary, s long, t int")
    from pyspark.sql import functions as F

    packed = df.withColumn("p", keys.internal_key(F.col("k"), F.col("s"), F.col("t"))).withColumn("u", keys.internal_parts(F.col("p")))
    for r in packed.collect():
        assert bytes(r.p) == keys.pack(bytes(r.k), r.s, r.t) and keys.unpack(bytes(r.p)) == (bytes(r.k), r.s, r.t)
        assert (bytes(r.u.ukey), r.u.seq, r.u.kt) == (bytes(r.k), r.s, r.t)
    bad = spark.createDataFrame([(bytearray(b"short"),), (bytearray(b"12345678"),)], "p binary").select(keys.internal_parts(F.col("p")).alias("u"))
    assert [r.u for r in bad.collect()] == [None, None]
    for raw in (b"short", b"12345678"):
        with pytest.raises(Corrupted):
            keys.unpack(raw)


def test_ordered_longs(spark):
    from pyspark.sql import functions as F

    values = [0, 1, -1, 5, -5, 2**63 - 1, -(2**63), 255, 256]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", keys.ordered_long(F.col("v")).alias("k"))
    assert [r.v for r in df.orderBy("k").collect()] == sorted(values)
    assert all(r.v == r.b for r in df.select("v", keys.ordered_long_back(F.col("k")).alias("b")).collect())


def test_separators():
    pick_ = random.Random(1)
    for _ in range(3000):
        a, b = sorted(bytes(pick_.choices([0, 1, 97, 98, 255], k=pick_.randrange(6))) for _ in range(2))
        if a < b:
            x = keys.separator(a, b)
            assert a <= x < b and len(x) <= len(a)
        s = keys.successor(a)
        assert s >= a and len(s) <= max(len(a), 0)
    assert keys.separator(b"abcde", b"abzz") == b"abd" and keys.successor(b"abc") == b"b" and keys.successor(b"\xff\xff") == b"\xff\xff"


def test_varints():
    for n in (0, 1, 127, 128, 300, 2**32, 2**64 - 1):
        assert keys.get_uvarint(keys.put_uvarint(n), 0) == (n, len(keys.put_uvarint(n)))
    with pytest.raises(Corrupted):
        keys.get_uvarint(b"\x80", 0)


def test_bloom(spark):
    from pyspark.sql import functions as F

    made = [bytes(random.Random(i).randbytes(4)) for i in range(20_000)]
    f = bloom.Bloom.build(made)
    assert all(bloom.Bloom.may_hold(f, k) for k in made)
    assert sum(bloom.Bloom.may_hold(f, b"no%d" % i) for i in range(5000)) < 150
    assert bloom.Bloom.build([]) == bytes(8) + b"\x07"
    df = spark.createDataFrame([(i % 3, bytearray(k)) for i, k in enumerate(made[:3000])], "g int, k binary")
    assert all(r.h == bloom.fnv1(bytes(r.k)) for r in df.select("k", bloom.fnv1_column(F.col("k")).alias("h")).collect())
    filters = bloom.build_bits(df, "g", "k")
    for r in filters.collect():
        own = [k for i, k in enumerate(made[:3000]) if i % 3 == r.g]
        raw = bloom.Bloom.build(list(dict.fromkeys(own)))
        assert [i for i in range(r.n_bits) if raw[i >> 3] >> (i & 7) & 1] == r.bits
    assert bloom.may_hold(filters, df, "g", "k").where("not maybe").count() == 0


def test_bloom_asked_by_words(spark):
    """Words and bit numbers answer as the byte form does, for repeated, null and absent keys; no row holds a whole filter."""
    held = {g: [b"%d/%d" % (g, i) for i in range(n)] for g, n in ((0, 1), (1, 40), (2, 3000))}
    df = spark.createDataFrame([(g, bytearray(k)) for g, ks in held.items() for k in ks], "g int, k binary")
    rows = [(i, g, k) for g in (0, 1, 2) for i, k in enumerate([*held[g][:50], *(b"no%d" % i for i in range(400)), b"", held[g][0]])] + [(0, 0, None), (0, None, b"x"), (0, 9, b"x"), (7, 2, b"twice"), (7, 2, b"twice")]
    asked = spark.createDataFrame([(i, g, None if k is None else bytearray(k)) for i, g, k in rows], "i int, g int, k binary")
    raw = {g: bloom.Bloom.build(ks) for g, ks in held.items()}
    want = sorted(((i, g, k, g in raw and k is not None and bloom.Bloom.may_hold(raw[g], k)) for i, g, k in rows), key=repr)
    words = bloom.build_words(df, "g", "k")
    for filters in (words, bloom.build_bits(df, "g", "k")):
        got = bloom.may_hold(filters, asked, "g", "k")
        assert got.columns == ["i", "g", "k", "maybe"]
        assert sorted(((r.i, r.g, None if r.k is None else bytes(r.k), r.maybe) for r in got.collect()), key=repr) == want
    assert any(not w[3] for w in want) and sum(w[3] for w in want if w[2] and w[2][:2] == b"no") > 0


@pytest.mark.parametrize("name", ["bloom_probe", "bloom_probe_absent"])
def test_no_filter_in_a_row(spark, name):
    """The time of a key asked does not grow with the keys of its filter."""
    from tidemark import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_except" not in plan


def test_journal_framing():
    out = journal.Writer()
    body = [bytes([1, 2, 3, 4]) * 1024] * 8 + [bytes([1, 2, 3, 4]) * 256, b"hello", b"apple juice", b"apple rice"]
    sizes = [out.chunk(c) for c in body]
    assert sizes[0] == 4103 and sizes[-3:] == [12, 18, 17]
    assert list(journal.chunks(bytes(out.data))) == body
    assert [k for _, _, k, _ in journal.records(bytes(out.data))][6:10] == [1, 2, 4, 1]
    assert journal.Writer().chunk(b"") == 0
    broken = bytearray(out.data)
    broken[5000] ^= 1  # the second chunk's block is dropped from there
    assert list(journal.chunks(bytes(broken))) == [body[0], *body[8:]]
    assert list(journal.chunks(bytes(out.data)[:-3])) == body[:-1]
    for n in range(32_740, 32_780):  # chunks that end about a block's end
        w = journal.Writer()
        w.chunk(b"x" * n)
        w.chunk(b"next")
        assert list(journal.chunks(bytes(w.data))) == [b"x" * n, b"next"]


def test_batches():
    entries = [(PUT, b"k", b"v"), (DELETE, b"gone", None), (PUT, b"", b""), (PUT, b"x" * 300, b"y" * 70_000)]
    raw = journal.encode_batch(9, entries)
    assert list(journal.decode_batch(raw, 9)) == [(9 + i, *e) for i, e in enumerate(entries)]
    with pytest.raises(BatchHeaderError):
        list(journal.decode_batch(raw, 10))
    for bad in (raw[:5], raw[:-1], raw + b"z", raw[:12] + b"\x07" + raw[13:]):
        with pytest.raises(Corrupted):
            list(journal.decode_batch(bad))


def names(limit):
    out, total, letters = [], 0, "abcdefghijklmnopqrstuvwxyz"
    prefix = ""
    while total < limit:
        for c in letters:
            out.append((prefix + c).encode())
            total += len(out[-1])
        prefix += "z"
    return out


def test_blocks():
    rows = [(k, k) for k in names(1 << 15)]
    block = tablefile.Block(tablefile.build_block(rows))
    assert list(block.scan()) == rows
    for probe in (b"", b"a", b"zzb", b"zzzzq0", b"~"):
        assert list(block.seek(probe)) == [r for r in rows if r[0] >= probe]
    assert list(tablefile.Block(tablefile.build_block([])).seek(b"a")) == []


def test_tables():
    rows = [(b"key-%05d" % i, b"value-%d" % i * (i % 7)) for i in range(0, 4000, 2)]
    data = tablefile.build_table(rows)
    t = tablefile.Table(data)
    assert list(t.scan()) == rows
    for k, v in rows[::97]:
        assert t.get(k) == v and t.find_key(k) == k
    assert t.get(b"key-00001") is None and t.find(b"key-00001") == rows[1] and t.find(b"z") is None
    assert data[-8:].hex() == "57fb808b247547db"
    with pytest.raises(Corrupted):
        tablefile.Table(data[:-1])
    broken = bytearray(data)
    broken[100] ^= 1
    with pytest.raises(Corrupted):
        list(tablefile.Table(bytes(broken)).scan())
    assert list(tablefile.Table(tablefile.build_table([])).scan()) == []


def f(level, num, low, high, size=100):
    return File(level, num, size, low.encode(), high.encode())


def test_version_edits():
    v = Version()
    one = Edit(add=[f(0, 0, "aaaaaa", "bbbbbb"), f(0, 1, "cccccc", "dddddd"), f(0, 2, "eeeeee", "ffffff"), f(0, 3, "aaaaaa", "ffffff"), f(1, 4, "iiiiii", "jjjjjj")])
    two = Edit(add=[f(1, 5, "kkkkkk", "llllll"), f(1, 6, "mmmmmm", "nnnnnn")], delete=[(1, 5)])
    assert [x.num for x in two.net().add] == [6] and two.net().delete == []
    want = [([0, 1, 2, 3], [4]), ([0, 1, 2, 3], [4, 6]), ([0, 1, 2, 3], [4]), ([0, 1, 2, 3], [])]
    for edit, (l0, l1) in zip([one, two, Edit(delete=[(1, 6)]), Edit(delete=[(1, 4)])], want, strict=True):
        v = v.apply(edit)
        v.check()
        assert ([x.num for x in v.level(0)], [x.num for x in v.level(1)]) == (l0, l1)
    assert v.depth == 1
    with pytest.raises(Corrupted):
        v.apply(Edit(add=[f(1, 9, "a", "f"), f(1, 10, "f", "g")])).check()


def test_planning():
    o = Options()
    l0 = [f(0, i, a, b) for i, (a, b) in enumerate([("a", "c"), ("b", "e"), ("e", "f"), ("m", "n"), ("p", "q")])]
    assert {x.num for x in closure(l0, [l0[0]])} == {0, 1, 2}
    assert pick(Version(l0), o) is None
    many = [f(0, i, "a", "b") for i in range(12)]
    plan = pick(Version([*many, f(1, 50, "b", "d"), f(1, 51, "x", "z"), f(2, 60, "c", "e")]), o)
    assert (plan.level, len(plan.inputs), [x.num for x in plan.below], [x.num for x in plan.grandparents]) == (0, 12, [50], [60])
    big = [f(1, i, chr(97 + i), chr(97 + i), 60 << 20) for i in range(4)]
    plan = pick(Version(big, pointers={1: b"b"}), o)
    assert (plan.level, [x.num for x in plan.inputs], plan.trivial(o)) == (1, [2], True)
    assert plan.moved().add[0].level == 2 and plan.moved().delete == [(1, 2)]
    assert pick(Version(big, pointers={1: b"z"}), o).inputs[0].num == 0
    assert [back_pressure(*a) for a in ((0, True), (8, True), (9, False), (12, True), (12, False), (3, False))] == ["go", "slow", "slow", "go", "pause", "rotate"]


def test_crc_is_the_usual_one():
    assert zlib.crc32(b"123456789") == 0xCBF43926


def test_replay_of_files(spark, tmp_path):
    want = []
    for n in range(3):
        out = journal.Writer()
        for b in range(2):
            entries = [(PUT, b"k%d" % i, b"v" * i) for i in range(3)] + [(DELETE, b"k1", None)]
            base = 1 + 8 * n + 4 * b
            out.chunk(journal.encode_batch(base, entries))
            want += [(base + i, *e) for i, e in enumerate(entries)]
        (tmp_path / f"{n:06d}.log").write_bytes(bytes(out.data))
    rows = journal.replay(spark, f"file://{tmp_path}", since=6).collect()
    assert sorted((r.seq, r.kt, bytes(r.ukey), None if r.value is None else bytes(r.value)) for r in rows) == [w for w in want if w[0] >= 6]


def test_delta_of_versions(spark):
    """Numbers of any sign and distance, repeated or null; what is shuffled is a row a word of 64 numbers."""
    from tidemark.plans.manifest import delta

    old = [0, 1, 63, 64, 64, 65, -1, -64, -65, 2**62, 2**63 - 1, -(2**63), None, *range(1000, 3000)]
    new = [1, 1, 62, 63, 64, 127, -1, -2, -64, 2**62 + 1, 2**63 - 1, *range(2000, 4000)]
    frame = lambda nums: spark.createDataFrame([(n,) for n in nums], "num long")
    want = [("add", n) for n in set(new) - set(old)] + [("del", n) for n in set(old) - set(new)]
    assert sorted((tuple(r) for r in delta(frame(old), frame(new)).collect()), key=repr) == sorted(want, key=repr)
    assert [tuple(r) for r in delta(frame(new), frame([*new, None])).collect()] == [("add", None)]
    assert delta(frame(old), frame(old)).count() == delta(frame([]), frame([])).count() == 0
    ids = spark.range(64_000).withColumnRenamed("id", "num")
    made = delta(ids.where("num % 3 = 0"), ids.where("num % 3 <> 0"))
    assert made.count() == 64_000
    moved = made.groupBy().count()
    moved.collect()
    rows = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            rows.append(node.metrics().get("shuffleRecordsWritten").get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(moved._jdf.queryExecution().executedPlan())
    assert rows and max(rows) < 20_000

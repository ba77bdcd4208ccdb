import random

import pytest

from tidemark.errors import Closed, Conflict, NotFound, ReadOnly
from tidemark.operators.compaction import compacted
from tidemark.options import DELETE, PUT, Options
from tidemark.plans.manifest import Edit, File
from tidemark.sources.store import Store


def model_get(rows, key, at):
    best = max((r for r in rows if r[0] == key and r[1] <= at), key=lambda r: r[1], default=None)
    return None if best is None or best[2] == DELETE else best[3]


def live(rows, at):
    return {k: model_get(rows, k, at) for k in {r[0] for r in rows} if model_get(rows, k, at) is not None}


def scan(store, at=None):
    return {bytes(r.ukey): bytes(r.value) for r in store.scan(at).collect()}


def test_compaction_keeps_every_read(spark):
    pick = random.Random(1)
    for case in range(6):
        keys = [b"", b"a", b"ab", b"\x7f", b"\x80", b"\xff"]
        rows = [(pick.choice(keys), s, pick.choice([PUT, PUT, DELETE]), b"") for s in range(1, 40)]
        rows = [(k, s, t, None if t == DELETE else b"v%d" % s if s % 5 else b"") for k, s, t, _ in rows]
        deep = [(b"a", b"ab"), (b"\xf0", b"\xff")] if case % 2 else None
        df = spark.createDataFrame([(bytearray(k), s, t, v if v is None else bytearray(v)) for k, s, t, v in rows], "ukey binary, seq long, kt byte, value binary")
        ranges = spark.createDataFrame([tuple(map(bytearray, d)) for d in deep], "min_key binary, max_key binary") if deep else None
        keep = pick.randrange(0, 40)
        after = [(bytes(r.ukey), r.seq, r.kt, r.value if r.value is None else bytes(r.value)) for r in compacted(df, keep, ranges).collect()]
        assert set(after) <= set(rows)
        for at in range(keep, 41):
            assert live(after, at) == live(rows, at)
        for k, s, t, _ in after:  # what may go has gone
            newer = [r[1] for r in rows if r[0] == k and r[1] > s]
            assert not newer or min(newer) > keep
            assert t == PUT or s > keep or any(a <= k <= b for a, b in deep or [])


def test_random_history(spark, tmp_path):
    pick = random.Random(2)
    root = f"file://{tmp_path}/s"
    o = Options(write_buffer=400, table_size=2000, l0_slowdown=2, l0_pause=3, level_base=3000)
    store = Store.open(spark, root, o)
    rows, snaps = [], []
    held = None
    for step in range(30):
        batch = []
        for _ in range(pick.randrange(1, 8)):
            k = b"k%02d" % pick.randrange(12)
            batch.append((DELETE, k, None) if pick.random() < 0.3 else (PUT, k, b"%d-" % step * pick.randrange(4)))
        store.write(batch)
        for kind, k, v in batch:
            rows.append((k, len(rows) + 1, kind, v))
        assert store.seq == len(rows)
        if step == 12:
            held = store.snapshot()
            snaps.append(held.__enter__())
    with pytest.raises(Conflict):
        other = Store.open(spark, root, Options(read_only=True))
        other._commit(Edit(add=[]))
        store._commit(Edit(add=[]))
    store = Store.open(spark, root, o)  # the buffer comes back from the journal
    store.snapshots = list(snaps)
    assert scan(store) == live(rows, len(rows)) and store.seq == len(rows)
    store.flush()
    store.compact()
    store.version.check()
    for at in [*snaps, len(rows)]:
        assert scan(store, at) == live(rows, at)
    for k in {r[0] for r in rows}:
        want = model_get(rows, k, len(rows))
        if want is None:
            with pytest.raises(NotFound):
                store.get(k)
        else:
            assert store.get(k) == want
    # shallower levels hold newer versions of a key than deeper ones
    seen = {}
    for level in range(store.version.depth):
        for r in store._read(store.version.level(level)).collect() if store.version.level(level) else []:
            seen.setdefault(bytes(r.ukey), {}).setdefault(level, []).append(r.seq)
    for levels in seen.values():
        for a in levels:
            assert all(min(levels[a]) > max(levels[b]) for b in levels if b > a)
    assert store.vacuum() >= 0 and scan(store) == live(rows, len(rows))
    keys = spark.createDataFrame([(bytearray(b"k00"),), (bytearray(b"nope"),)], "ukey binary")
    assert store.multi_get(keys).count() == 2
    assert {bytes(r.ukey) for r in store.scan(low=b"k03", high=b"k07").collect()} == {k for k in live(rows, len(rows)) if b"k03" <= k < b"k07"}


def test_bulk_checkpoints_and_modes(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    with Store.open(spark, root) as store:
        with pytest.raises(NotFound):
            store.get(b"a")
        df = spark.range(1000).selectExpr("cast(cast(id % 100 as string) as binary) ukey", "1 kt", "cast(cast(id as string) as binary) value", "id")
        assert store.bulk_write(df, ["id"], {"src": 0}) == 1000
        assert store.bulk_write(df, ["id"], {"src": 0}) == 1000  # the same batch again
        assert store.get(b"7") == b"907" and store.scan().count() == 100
        with store.pinned() as v:
            store.compact()
            assert len(v.files) >= 1
        for i in range(55):
            store._commit(Edit(add=[File(3, 900 + i, 1, b"%03d" % i, b"%03d" % i, path="none")]))
            store._commit(Edit(delete=[(3, 900 + i)]))
    again = Store.open(spark, root, Options(read_only=True))
    assert again.version.number > 100 and again.scan().count() == 100 and again.applied == {"src": 0}
    with pytest.raises(ReadOnly):
        again.put(b"a", b"b")
    with pytest.raises(Closed):
        store.get(b"a")


def test_streaming_ingest(spark, tmp_path):
    from tidemark.streaming.ingest import ingest

    for i in range(3):
        spark.range(i * 50, i * 50 + 50).selectExpr("id").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    changes = stream.selectExpr("cast(cast(id % 10 as string) as binary) ukey", "cast(case when id % 7 = 0 then 2 else 1 end as byte) kt", "case when id % 7 <> 0 then cast(cast(id as string) as binary) end value", "id")
    store = Store.open(spark, f"file://{tmp_path}/st")
    ingest(changes, store, ["id"], f"file://{tmp_path}/ck").awaitTermination()
    assert store.seq == 150 and len(store.version.files) >= 3
    latest = {}
    for r in store.changes().orderBy("seq").collect():
        latest[bytes(r.ukey)] = None if r.kt == 2 else bytes(r.value)
    assert scan(store) == {k: v for k, v in latest.items() if v is not None}


def test_as_of_reads(spark):
    from tidemark.operators.reads import ChangeLog

    pick = random.Random(5)
    rows = [(pick.choice("abc"), s, pick.choice([PUT, PUT, DELETE]), s * 1.5) for s in pick.sample(range(1000), 150)]
    probes = [(pick.choice("abcd"), pick.randrange(-50, 1100)) for _ in range(200)] + [("a", None), ("a", rows[0][1]), ("a", rows[0][1])]
    log = ChangeLog(spark.createDataFrame(rows, "k string, seq long, kt int, val double"), ("k",))
    want = []
    for k, at in probes:
        seen = [r for r in rows if r[0] == k and at is not None and r[1] <= at]
        best = max(seen, key=lambda r: r[1], default=None)
        want.append((k, at, *((best[1], best[3]) if best and best[2] == PUT else (None, None))))
    for parts in (1, 7, 64):
        got = log.as_of(spark.createDataFrame(probes, "k string, at long"), "at", parts).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    nothing = log.over(log.df.where("false")).as_of(spark.createDataFrame(probes, "k string, at long"), "at")
    assert nothing.where("seq is not null").count() == 0 and nothing.count() == len(probes)


def test_bulk_write_keeps_rows_without_an_order(spark, tmp_path):
    rows = [(b"a", 1, b"1", 1), (b"b", 1, b"2", None), (b"a", 1, b"3", None), (b"c", 1, b"4", 7)]
    store = Store.open(spark, str(tmp_path / "nulls"))
    store.bulk_write(spark.createDataFrame(rows, "ukey binary, kt int, value binary, event_id long"), ["event_id", "ukey"])
    assert {bytes(r.ukey): bytes(r.value) for r in store.scan().collect()} == {b"a": b"3", b"b": b"2", b"c": b"4"}


def test_numbers_of_any_order(spark):
    from datetime import datetime

    from tidemark.operators.reads import assign_sequence

    rows = [(i, v, t) for i, (v, t) in enumerate([(None, None), ("b", None), ("a", datetime(2020, 1, 2)), (None, datetime(2020, 1, 1)), ("a", datetime(2020, 1, 1)), ("", None), ("a", datetime(2020, 1, 1)), (None, None)])]
    df = spark.createDataFrame(rows, "i long, s string, t timestamp")
    key = lambda v: (v is None, v)
    for order in (["s"], ["t", "s"], ["s", "t", "i"]):
        for parts in (None, 1, 5):
            got = sorted(assign_sequence(df, order, 10, parts).collect(), key=lambda r: r.seq)
            assert [r.seq for r in got] == list(range(11, 19)) and {r.i for r in got} == set(range(8))
            keys = [tuple(key(r[c]) for c in order) for r in got]
            assert [[(n, v) for n, v in k] for k in keys] == sorted([[(n, v) for n, v in k] for k in keys], key=lambda k: [(n, v if not n else 0) for n, v in k])
    same = spark.range(3000).selectExpr("7 as a", "id", "binary('x') as `a.b`")
    assert sorted(r.seq for r in assign_sequence(same, ["a"], 0).collect()) == list(range(1, 3001))
    assert assign_sequence(df.where("false"), ["s"], 0).collect() == []


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/two"
    a, b = Store.open(spark, root), Store.open(spark, root)
    a.put(b"k1", b"a")
    with pytest.raises(Conflict):
        b.put(b"k2", b"b")
    b.refresh()
    assert b.get(b"k1") == b"a" and b.put(b"k2", b"b") == 2
    changes = spark.createDataFrame([(b"k3", 1, b"c", 1)], "ukey binary, kt int, value binary, o long")
    with pytest.raises(Conflict):
        a.bulk_write(changes, ["o"])
    a.refresh()
    assert a.bulk_write(changes, ["o"]) == 3
    with pytest.raises(Conflict):
        b.put(b"k4", b"d")
    b.refresh()
    assert b.put(b"k4", b"d") == 4
    assert scan(Store.open(spark, root)) == {b"k1": b"a", b"k2": b"b", b"k3": b"c", b"k4": b"d"}


def test_vacuum_leaves_what_others_need(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    a = Store.open(spark, root, Options(l0_pause=2))
    df = spark.createDataFrame([(b"k%d" % i, 1, b"v", i) for i in range(20)], "ukey binary, kt int, value binary, o long")
    a.bulk_write(df, ["o"])
    reader = Store.open(spark, root, Options(read_only=True))
    with reader.pinned() as held:
        a.bulk_write(df, ["o"])
        a.compact()
        assert a.vacuum() == 0  # young
        assert a.vacuum(0) >= 1  # the second write's table
        assert reader.changes(version=held).count() == 20
    assert a.vacuum(0) >= 1 and scan(a) == {b"k%d" % i: b"v" for i in range(20)}
    # tables of a commit that is running
    with a._tables(df.selectExpr("ukey", "o + 100 as seq", "cast(kt as byte) as kt", "value"), 0) as files:
        assert Store.open(spark, root).vacuum(0) == 0
        a._commit(Edit(add=files, seq=200, next_file=a.version.next_file + len(files)))
    assert a.vacuum(0) == 0 and scan(a) == {b"k%d" % i: b"v" for i in range(20)}


def test_snapshots_of_other_processes_hold_versions(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    a = Store.open(spark, root, Options(l0_pause=2))
    a.bulk_write(spark.createDataFrame([(b"k", 1, b"old", 1)], "ukey binary, kt int, value binary, o long"), ["o"])
    other = Store.open(spark, root, Options(read_only=True))
    with other.snapshot() as at:
        a.bulk_write(spark.createDataFrame([(b"k", 1, b"new", 1)], "ukey binary, kt int, value binary, o long"), ["o"])
        assert a.compact() >= 1
        assert scan(a, at) == {b"k": b"old"} and scan(a) == {b"k": b"new"}
    assert a.held() == []


def test_outputs_end_at_grandparents(spark, tmp_path):
    from tidemark.plans.manifest import Compaction, grandparent_cuts

    grand = [File(2, 50 + i, 100, b"k%02d" % (10 * i), b"k%02d" % (10 * i + 9)) for i in range(10)]
    assert grandparent_cuts(grand, 250) == [b"k19", b"k39", b"k59", b"k79"] and grandparent_cuts(grand, 5000) == [] and grandparent_cuts([], 1) == []
    store = Store.open(spark, f"file://{tmp_path}/g", Options(split_grandparents=0))
    rows = [(b"k%02d" % i, 1, b"v", i) for i in range(100)]
    for half in (rows[::2], rows[1::2]):
        store.bulk_write(spark.createDataFrame(half, "ukey binary, kt int, value binary, o long"), ["o"])
    store._run(Compaction(0, store.version.level(0), [], grand))
    made = store.version.level(1)
    assert scan(store) == {k: v for k, _, v, _ in rows}
    assert len(made) == 10 and all(sum(g.meets(f.min_key, f.max_key) for g in grand) == 1 for f in made)


def test_tombstones_meet_ranges_without_nested_loops(spark):
    from tidemark.operators.compaction import drop_tombstones, islands

    pick = random.Random(9)
    for n in (0, 1, 40):
        ranges = [(lo, lo + pick.randrange(4)) for lo in (pick.randrange(300) for _ in range(n))]
        rows = [(k, s, pick.choice([PUT, DELETE])) for s, k in enumerate(pick.choices(range(310), k=200))]
        log, deep = spark.createDataFrame(rows, "ukey long, seq long, kt int"), spark.createDataFrame(ranges, "min_key long, max_key long")
        out = drop_tombstones(log, 150, deep)
        want = [r for r in rows if r[2] == PUT or r[1] > 150 or any(a <= r[0] <= b for a, b in ranges)]
        assert sorted(map(tuple, out.collect())) == sorted(want)
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
        merged = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2] + 1)
            else:
                merged.append((a, b, 1))
        assert sorted((r.island, r.min_key, r.max_key, r.n) for r in islands(deep, "min_key", "max_key").collect()) == [(i, *m) for i, m in enumerate(merged, 1)]

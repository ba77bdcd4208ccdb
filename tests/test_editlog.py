import time

import pytest

from tidemark.errors import Corrupted
from tidemark.plans.manifest import Edit, File, Version
from tidemark.sources import editlog, journal


def test_round_trip_and_recovery():
    files = [File(n % 3, n, 100 + n, b"a%03d" % n, b"b%03d" % n) for n in range(300)]
    edits = [Edit(comparer="bytewise", journal=1, next_file=2, seq=0), Edit(add=files, seq=500, pointers={1: b"\x00\xff"}), Edit(delete=[(0, 3), (1, 4)], next_file=301, seq=2**56 - 1, journal=9), Edit(add=[File(0, 3, 7, b"", b"\xff" * 40_000)])]
    for e in edits:
        assert editlog.decode(editlog.encode(e)) == e
    v = editlog.recover(editlog.write_log(edits))
    want = Version()
    for e in edits:
        want = want.apply(e)
    assert v == want and len(v.files) == 299 and v.pointers == {1: b"\x00\xff"}
    again = editlog.recover(editlog.write_log([editlog.snapshot(v)]))
    assert (sorted(again.files, key=repr), again.seq, again.next_file, again.journal) == (sorted(v.files, key=repr), v.seq, v.next_file, v.journal)


def test_bad_logs():
    with pytest.raises(Corrupted, match="comparer"):
        editlog.recover(editlog.write_log([Edit(seq=1, next_file=1, journal=1)]))
    for raw in (b"\x08\x01", b"\x01\x05ab", b"\x07\x00"):
        with pytest.raises(Corrupted):
            editlog.decode(raw)


def test_log_in_segments(spark):
    """A log that is cut anywhere gives the version of the whole log, scalars and pointers too."""
    edits = [Edit(comparer="bytewise", journal=7, next_file=2, seq=0), Edit(add=[File(0, n, n, b"a", b"b") for n in range(5)], pointers={1: b"k"}), Edit(delete=[(0, 3)], seq=9, comparer=""), Edit(add=[File(0, 3, 8, b"", b"\xff" * 40_000)], next_file=6), Edit(delete=[(0, 1), (2, 2)], journal=3, pointers={1: b"\x00", 2: b""}), Edit(add=[File(1, 4, 1, b"x", b"y")], delete=[(1, 4), (0, 0)])]
    want = editlog.recover(editlog.write_log(edits))
    for cut in ([0, 6], [0, 1, 2, 3, 4, 5, 6], [0, 4, 6]):
        rows = [(i, bytearray(editlog.write_log(edits[a:b]))) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
        got = editlog.recover_segments(spark.createDataFrame(rows[::-1], editlog.SEGMENTS))
        got.files.sort(key=repr)
        want.files.sort(key=repr)
        assert got == want
    with pytest.raises(Corrupted, match="seq"):
        editlog.recover_segments(spark.createDataFrame([(0, bytearray(editlog.write_log([Edit(comparer="b", next_file=1, journal=1)])))], editlog.SEGMENTS))


def row_edit(r):
    return Edit(add=[File(0, r["n"] % 7, r["n"], b"a", b"b" * 3000)], seq=r["n"]) if r["n"] % 3 else Edit(delete=[(0, r["n"] % 7)], seq=r["n"])


def test_segments_keep_the_order_and_are_bounded(spark):
    rows = spark.range(2000).selectExpr("1999 - id as n").repartition(3)
    log = sorted((r.place, bytes(r.data)) for r in editlog.segments(rows, row_edit, ["n"]).collect())
    assert len(log) > 3 and all(len(data) < editlog.SEGMENT + 8000 for _, data in log)
    back = [editlog.decode(c) for _, data in log for c in journal.chunks(data)]
    assert back == [row_edit({"n": n}) for n in range(2000)]


def test_long_log_is_folded_in_linear_time():
    """An edit costs its own files, not those of the version."""
    adds = Edit(comparer="b", journal=0, next_file=0, seq=0, add=[File(0, n, 1, b"a", b"b") for n in range(20_000)])
    start = time.process_time()
    v = editlog.recover(editlog.write_log([adds, *(Edit(delete=[(0, n)]) for n in range(5000))]))
    assert len(v.files) == 15_000 and v.number == 5001 and time.process_time() - start < 5


def test_manifest_rewrite_leaves_the_log_on_the_executors(spark, monkeypatch):
    """The driver encodes the first edit and the version, whatever the number of orders."""
    from tidemark import registry

    made, real = [], editlog.encode
    monkeypatch.setattr(editlog, "encode", lambda e: made.append(e) or real(e))
    assert registry.queries()["manifest_rewrite"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 2

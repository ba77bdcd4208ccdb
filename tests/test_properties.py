"""Properties of the codecs on generated input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import bloom, keys
from tidemark.options import DELETE, MAX_SEQ, PUT
from tidemark.plans.manifest import Edit, File, Version
from tidemark.sources import journal, tablefile

BYTES = st.binary(max_size=40)


@given(BYTES, st.integers(0, MAX_SEQ), st.sampled_from([PUT, DELETE]))
def test_internal_keys(key, seq, kind):
    assert keys.unpack(keys.pack(key, seq, kind)) == (key, seq, kind)


@given(BYTES, BYTES)
def test_separators(a, b):
    if a < b:
        assert a <= keys.separator(a, b) < b
    assert keys.successor(a) >= a


@given(st.lists(st.binary(max_size=70_000), max_size=6), st.data())
@settings(max_examples=40, deadline=None)
def test_journal(chunks, data):
    out = journal.Writer()
    for c in chunks:
        out.chunk(c)
    whole = bytes(out.data)
    assert list(journal.chunks(whole)) == [c for c in chunks if c]
    cut = whole[: data.draw(st.integers(0, len(whole)))]
    got = list(journal.chunks(cut))
    assert got == [c for c in chunks if c][: len(got)]  # a torn tail loses only the end


@given(st.lists(st.tuples(st.sampled_from([PUT, DELETE]), BYTES, BYTES), max_size=30), st.integers(0, MAX_SEQ))
def test_batches(entries, base):
    entries = [(t, k, v if t == PUT else None) for t, k, v in entries]
    assert [(t, k, v) for _, t, k, v in journal.decode_batch(journal.encode_batch(base, entries))] == entries


@given(st.dictionaries(BYTES, BYTES, max_size=120), BYTES)
@settings(deadline=None)
def test_tables(rows, probe):
    ordered = sorted(rows.items())
    t = tablefile.Table(tablefile.build_table(ordered, block_size=64, restart=3))
    assert list(t.scan()) == ordered
    assert t.get(probe) == rows.get(probe)
    assert t.find(probe) == next((r for r in ordered if r[0] >= probe), None)
    for k, v in ordered[:20]:
        assert t.get(k) == v


@given(st.lists(BYTES, max_size=60))
def test_bloom_has_no_false_negative(made):
    f = bloom.Bloom.build(made)
    assert all(bloom.Bloom.may_hold(f, k) for k in made)


@given(st.lists(st.lists(st.tuples(st.booleans(), st.integers(0, 3), st.integers(0, 6)), max_size=8), max_size=6))
def test_edits_fold_to_the_last_action(steps):
    version, live = Version(), set()
    for step in steps:
        edit = Edit(add=[File(level, num, 1, b"%d" % num, b"%d" % num) for add, level, num in step if add], delete=[(level, num) for add, level, num in step if not add])
        added, gone = {(f.level, f.num) for f in edit.add}, set(edit.delete)
        live = (live - gone) | (added - gone)
        version = version.apply(edit)
        # a file added and deleted by one edit nets out and leaves what was there before
        live |= {x for x in added & gone if x in {(f.level, f.num) for f in version.files}}
        assert {(f.level, f.num) for f in version.files} == live

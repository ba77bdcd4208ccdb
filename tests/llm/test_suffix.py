import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.suffix import anchors, op7_suffix_dedup, remove_repeats, repeated_windows, sliding_argmin


def slow(texts, width):
    """[(n_bytes, n_removed, n_spans, kept)] by counting all windows"""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def test_sliding_argmin():
    h = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    for w in (1, 2, 7, 137, 500):
        assert sliding_argmin(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(500 - w + 1)]


def test_windows_are_owned_once(monkeypatch):
    import tidemark.llm.suffix as S

    pick = random.Random(2)
    texts = [bytes(pick.choices(b"ab", k=n)) for n in (0, 19, 20, 21, 500, 3000, 40)] + [b"a" * 900]
    for chunk in (1 << 19, 128):
        monkeypatch.setattr(S, "CHUNK", chunk)
        owner, h, first, n, seg = anchors(texts, 20, 6)
        assert sorted((o, i) for o, f, k in zip(owner.tolist(), first.tolist(), n.tolist(), strict=True) for i in range(f, f + k)) == [(o, i) for o, t in enumerate(texts) for i in range(len(t) - 19)]
        of = {}
        for o, a, f, k, s in zip(owner.tolist(), h.tolist(), first.tolist(), n.tolist(), seg.tolist(), strict=True):
            assert of.setdefault((a, s), (texts[o][f : f + k + 19], k)) == (texts[o][f : f + k + 19], k)
            for i in range(f, f + k):  # equal windows have equal anchors
                assert of.setdefault(texts[o][i : i + 20], a) == a


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd\x00\xff"])
def test_two_stage_sorting(alphabet):
    pick = random.Random(3)
    for _ in range(300):
        width = pick.randrange(1, 9)
        segments = []
        for _ in range(pick.randrange(1, 12)):
            n = pick.randrange(1, 15)
            segments.append((bytes(pick.choices(alphabet, k=n + width - 1)), n))
        seen = Counter(s[i : i + width] for s, n in segments for i in range(n))
        want = [[int(seen[s[i : i + width]] > 1) for i in range(n)] for s, n in segments]
        assert [f.tolist() for f in repeated_windows(segments, width)] == want


def check(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, n_spans int")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, **options).collect())
    assert got == Counter((k, *w) for (k, _), w in zip(rows, slow([t for _, t in rows], options.get("width", 200)), strict=True))


@pytest.mark.parametrize("block", [None, 3])
def test_random(spark, block):
    pick = random.Random(4)
    shared = ["".join(pick.choices("abcd é", k=pick.randrange(10, 80))) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [pick.choice(shared) if pick.random() < 0.4 else "".join(pick.choices("abcd é", k=pick.randrange(60))) for _ in range(pick.randrange(5))]
        rows.append((k, "".join(parts)))
    check(spark, rows, width=24, gram=7, block=block)


def test_edges(spark):
    one = "".join(random.Random(5).choices("abcdefgh é", k=400))
    rows = [(1, None), (2, ""), (3, one), (3, one), (4, "x" * 5000), (5, "short"), (5, "short"), (None, one[:150]), (None, one[100:330] + "tail"), (6, "é" * 150), (7, "ab" * 300), (8, one[:199]), (9, "q" + one[:200])]
    check(spark, rows)
    check(spark, rows, block=1)
    check(spark, [])
    check(spark, [(1, one)])


def test_text_form_leaves_out_split_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 300 + "end"), (2, "other")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in remove_repeats(docs, as_text=True).collect()} == {1: "end", 2: "other"}


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: (a, b, c, hashlib.sha256(x).hexdigest()) for (k, _), (a, b, c, x) in zip(docs, slow([t for _, t in docs], 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix_dedup(spark, sf).collect()} == want
    assert any(w[1] for w in want.values())


def test_nothing_goes_without_the_arrays(spark, monkeypatch):
    import tidemark.llm.suffix as S

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(S, "repeated_windows", lambda segments, *_: [np.zeros(n, bool) for _, n in segments])
    for block in (None, 2):
        assert remove_repeats(docs, block=block).where("n_removed > 0").count() == 0


def test_common_prefixes():
    from tidemark.llm.suffix import common_prefixes

    pick = random.Random(6)
    raw = np.frombuffer(bytes(pick.choices(b"ab", weights=[30, 1], k=3000)), np.uint8).astype(np.int16)
    a, b = (np.array([pick.randrange(2000) for _ in range(500)]) for _ in range(2))
    limit = np.array([pick.randrange(300) for _ in range(500)])
    slow_one = lambda i, j, n: next((k for k in range(n) if raw[i + k] != raw[j + k]), n)
    assert common_prefixes(raw, a, b, limit).tolist() == [slow_one(*x) for x in zip(a.tolist(), b.tolist(), limit.tolist(), strict=True)]


def test_sorting_only_first_suffixes():
    pick = random.Random(7)
    for _ in range(100):
        segments = [(bytes(pick.choices(b"ab", k=(n := pick.randrange(1, 30)) + 4)), n) for _ in range(pick.randrange(1, 6))]
        twice = segments + segments
        assert all(f.all() for f in repeated_windows(twice, 5, [1] * len(twice)))


def test_clashing_columns_and_other_names(spark):
    text = "".join(random.Random(8).choices("abcdefgh ", k=300))
    rows = [(1, text, 7, "s", None, 1.5), (2, text, 8, None, "x", 1.5), (3, "short", 9, "t", "y", 2.5)]
    docs = spark.createDataFrame(rows, "rk1 long, body string, rk int, spans string, text string, `a.b` double")
    got = {r.rk1: r for r in remove_repeats(docs, text_col="body").collect()}
    assert {k: (r.n_removed, r.rk, r.spans, r.text, r["a.b"]) for k, r in got.items()} == {1: (300, 7, "s", None, 1.5), 2: (300, 8, None, "x", 1.5), 3: (0, 9, "t", "y", 2.5)}


def test_a_text_and_its_null_neighbour_are_told_apart(spark):
    text = "".join(random.Random(9).choices("abcdefgh ", k=300))
    docs = spark.createDataFrame([(None, text), (text, None), (None, text), ("other", text)], "text string, title string")
    assert sorted(r.n_removed for r in remove_repeats(docs, text_col="title").collect()) == [0, 300, 300, 300]

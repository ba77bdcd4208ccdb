import hashlib
import random
import re

import numpy as np

from tidemark.llm import decontaminate as D


def slow_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(docs, items, width=10):
    wins = {}
    for k, t in items:
        w = slow_words(t)
        if w:
            for i in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[i : i + width]), set()).add("null" if k is None else str(k))
    sizes = {len(w) for w in wins}
    out = []
    for k, t in docs:
        w, hit, of = slow_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    of |= names
        out.append((k, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return out


def check(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in D.contamination(d, i, **more).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == sorted(slow(docs, items, **more), key=str)


def test_random(spark):
    pick = random.Random(5)
    text = lambda n: "".join(pick.choice(["a", "B", "é9", "zz"]) + pick.choice([" ", ", ", "\n", "-", "\t_"]) for _ in range(n))
    docs = [(k, text(pick.randrange(120))) for k in range(80)]
    items = [(k, text(pick.randrange(9))) for k in range(30)]
    check(spark, docs, items, width=4)


def test_edges(spark, monkeypatch):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "!!!"), (None, ten.upper()), (4, ten), (4, ten), (5, ten[:-4]), (6, "x " + ten + " " + ten), (7, "short item"), (8, "ten one " * 50_000), (9, "nine ten")]
    items = [(100, ten + " eleven"), (7, "Short, item"), (None, ten), (8, None), (9, " ?"), (7, "nine ten"), (11, "item nine")]
    check(spark, docs, items)
    monkeypatch.setattr(D, "SEGMENT_BYTES", 60)
    check(spark, docs, items)
    check(spark, [], items)
    check(spark, docs, [])


def test_query_blocks_are_merged(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "c d"), (3, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "b c", "c d", "d e", "zz"])], "item_id long, text string")
    D.write_index(docs, f"file://{tmp_path}/i")
    got = {r.doc_id: (len(r.hits), r["items"]) for r in D.scan(spark, f"file://{tmp_path}/i", items, 10, limit=1).collect()}
    assert got == {1: (4, ["0", "1", "2", "3"]), 2: (1, ["2"]), 3: (0, [])}


def test_collisions_of_the_upper_bits():
    texts = [b" ".join(b"w%d" % i for i in range(5000)), b"", b"w1 w1 w4999"]
    terms, ends, places, firsts, n = D.Segment.build(texts)
    seg = D.Segment(terms.split(b" ")[:-1], ends, places, firsts, n)
    assert seg.postings(b"w1").tolist() == [1, 5000, 5001] and len(seg.number) == 5000 and n == 5003
    assert seg.phrase([b"w4999", b"w1"]).tolist() == []


def test_proximity(spark, tmp_path):
    pick = random.Random(1)
    texts = ["".join(pick.choice("abcdefgh") + " " for _ in range(60)) for _ in range(20)]
    D.write_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"file://{tmp_path}/p")
    got = {tuple(r) for r in D.near_matches(spark, f"file://{tmp_path}/p", [["a", "b", "c"], ["none", "a"]], 5).collect()}
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        full = {(i, j) for i in range(60) for j in range(i, min(60, i + 5)) if {"a", "b", "c"} <= set(w[i : j + 1])}
        want |= {(0, d, i, j) for i, j in full if not any((c, e) != (i, j) and i <= c and e <= j for c, e in full)}
    assert got == want


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = D.op2_decontaminate(spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = slow(docs, items)
    assert sorted(map(tuple, got)) == sorted(want) and 0 < sum(w[-1] for w in want) < len(want)
    assert np.all([w[2] <= w[1] for w in want])


def test_digests_over_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(D.scan, "__defaults__", ("item_id", "text", 2, False))
    test_edges(spark, monkeypatch)


def test_words_of_one_hash_are_told_apart(spark):
    """A Thue-Morse word and its complement have the same polynomial hash modulo 2**64."""
    x = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    assert np.unique(D.hashes(np.frombuffer(f"{x} {y}".encode(), np.uint8), np.array([0, 1025]), np.array([1024, 2049]))).size == 1
    check(spark, [(1, f"{x} {y}"), (2, f"{y} {x} {y} q {x}"), (3, x), (4, "q")], [(1, y), (2, x), (3, f"{x} {y}"), (4, f"{y} q")])


def test_unlike():
    pick = random.Random(8)
    words_ = ["".join(pick.choices("ab", k=pick.randrange(1, 30))) for _ in range(300)] + ["a" * n for n in (7, 8, 9, 16, 17)]
    raw = np.frombuffer(" ".join(words_).encode(), np.uint8)
    starts, ends = D.spans(raw)
    a, b = (np.array([pick.randrange(len(words_)) for _ in range(3000)]) for _ in range(2))
    assert D.unlike(raw, starts, ends - starts, a, b).tolist() == [words_[i] != words_[j] for i, j in zip(a, b, strict=True)]


def test_near_items_against_brute_force(spark):
    pick = random.Random(9)
    docs = [(k, " ".join(pick.choices("abcdefghij", k=pick.randrange(90)))) for k in range(30)] + [(3, None), (None, "a b c d e f"), (None, "a b c d e f")]
    items = [(k, " ".join(pick.choices("abcdefghij", k=pick.randrange(8)))) for k in range(6)] + [(7, None)]
    width, span = 4, 6
    want = []
    for k, t in docs:
        w = slow_words(t)
        for item, x in items:
            v, found = slow_words(x), set()
            for s in range(max(1, len(v) - width + 1)) if v else ():
                terms = set(v[s : s + width])
                full = {(i, j) for i in range(len(w)) for j in range(i, min(len(w), i + span)) if terms <= set(w[i : j + 1])}
                found |= {(i, j) for i, j in full if not any((c, e) != (i, j) and i <= c and e <= j for c, e in full)}
            if found:
                want.append((k, str(item), len(found), *min(found)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1000, 2):
        got = [tuple(r) for r in D.near_items(d, i, width, span, limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and want

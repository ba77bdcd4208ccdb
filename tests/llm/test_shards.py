import zlib
from collections import Counter

import pytest

from tidemark.llm.shards import assign, op5_shards


def check(rows, want, shards=16):
    """rows of assign against the documents [(doc_id, text)]"""
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in want)
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards)) and (not rows or max(counts.values()) - min(counts[s] for s in range(shards)) <= 1)
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def holders(rows):
    """{crc: number of shards with documents of that text}"""
    return {c: len({r.shard for r in rows if r.text_crc32 == c}) for c in {r.text_crc32 for r in rows}}


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 100])
def test_sizes(spark, n):
    docs = [(k, f"text {k}") for k in range(n)]
    check(assign(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int")).collect(), docs)


def test_groups_stay_together(spark):
    docs = [(k, f"copy {k % 40}") for k in range(200)] + [(1000 + k, f"own {k}") for k in range(300)]
    rows = assign(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(rows, docs)
    assert max(holders(rows).values()) == 1  # no link is cut


def test_a_hot_group_takes_as_few_shards_as_it_can(spark):
    docs = [(k, "hot") for k in range(400)] + [(1000 + k, f"pair {k // 2}") for k in range(200)] + [(2000 + k, f"own {k}") for k in range(200)]
    rows = assign(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(rows, docs)
    held = holders(rows)
    assert held[zlib.crc32(b"hot")] <= 9  # 400 of 50 a shard
    assert sum(v > 1 for k, v in held.items() if k != zlib.crc32(b"hot")) <= 2


def test_edges(spark):
    docs = [(1, None), (1, None), (2, ""), (None, "a"), (None, "a"), (3, "é" * 100_000), (4, "same"), (4, "same"), (4, "same")]
    check(assign(spark.createDataFrame(docs, "doc_id long, text string"), shards=4).collect(), docs, 4)
    only = [(k, "same") for k in range(37)]
    check(assign(spark.createDataFrame(only, "doc_id long, text string"), shards=4).collect(), only, 4)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op5_shards(spark, sf).collect()
    check(rows, docs)
    assert max(holders(rows).values()) == 1

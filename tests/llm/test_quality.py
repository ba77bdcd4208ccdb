import zlib

import numpy as np

from tidemark.llm.quality import Model, fit, op9_quality, scored, singular_axes, terms


def test_terms_of_odd_texts():
    assert not terms(None).any() and not terms(b"").any()
    assert np.isfinite(terms(b"a")).all() and np.isfinite(terms("é x x\n\n".encode() * 90_000)).all()
    whole = terms(b"ab" * (1 << 20))  # counted in parts, with the pairs at the borders
    assert abs(float((whole[:-5] ** 2).sum()) - 1) < 1e-5


def test_singular_axes():
    a = np.random.default_rng(1).standard_normal((40, 30)).astype(np.float32)
    a[:, :3] *= 20
    want = np.linalg.svd(a, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(singular_axes(a, 2).T @ want.T), np.eye(2), atol=1e-2)


def test_votes_against_brute_force():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = Model(np.ones(8, np.float32), np.eye(8, dtype=np.float32), v, rng.integers(0, 2, 60).astype(float), 7)
    rows = np.abs(rng.standard_normal((20, 8))).astype(np.float32)
    for got, row in zip(m.scores(rows), rows, strict=True):
        cos = [float(row @ w / np.linalg.norm(row)) for w in v]
        near = sorted(range(60), key=lambda i: -cos[i])[:7]
        wt = [max(0, cos[i]) ** 16 for i in near]
        assert abs(got - sum(w * m.labels[i] for w, i in zip(wt, near, strict=True)) / sum(wt)) < 1e-4
    assert m.scores(np.zeros((1, 8), np.float32))[0] == m.labels.mean()


def test_edges(spark):
    docs = spark.createDataFrame([(k, t, 0.5, "x") for k, t in [(1, "good text here"), (2, None), (3, ""), (None, "good"), (1, "good text here"), (4, "### *** !!!")]], "doc_id long, text string, score double, quality string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, None), (4, 0), (None, 1), (99, 1), (3, 1)], "doc_id long, quality int")
    model = fit(docs, labels)
    rows = scored(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and rows[0].asDict().keys() == {"doc_id", "text", "quality", "score"}
    empty = fit(docs, labels.where("false"))
    assert {r.score for r in scored(docs, empty).collect()} == {0.5}
    assert scored(docs.where("false"), model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_quality(spark, sf).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    bad = [p for p, q in held if q == 0]
    good = [p for p, q in held if q == 1]
    assert 1 - sum(bad) / len(bad) > 0.95 and sum(good) / len(good) > 0.97


def test_labels_of_other_documents(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(1000, 1040)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1040)], "doc_id long, quality int")
    known = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(1000, 1040))
    assert len(fit(docs, labels, sample=40).labels) == known and len(fit(docs, labels, sample=7).labels) == 7

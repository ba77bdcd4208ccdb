import re

import xxhash

from tidemark.llm.components import components
from tidemark.llm.simhash import WordBits, fingerprint, keep_dissimilar, keep_one, links, near_duplicates, op10_simhash, segments_for


def slow_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(grams))


def slow_components(fps):
    """[(doc_id, fp)] -> {doc_id: component}"""
    parent = {k: k for k, _ in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k, _ in fps}


def slow_near(texts, width=5, least=0.8):
    """{key: text} -> {key: least key of its group}, by comparing all texts with all"""
    told = {}
    for k, t in texts.items():
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        grams = {i: tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else {}
        told[k] = (len(words), grams, set(grams.values()))

    def share(x, y):
        n, grams, _ = x
        return len({i + j for i, g in grams.items() if g in y[2] for j in range(len(g))}) / n if n and y[0] else float(n == y[0])

    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (told[a][2] & told[b][2] or not told[a][0] + told[b][0]) and min(share(told[a], told[b]), share(told[b], told[a])) >= least:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k in keys}


def test_fingerprint():
    for t in ["", None, "One", "one TWO", "a b c", "É x\x1cy z\x0bq a b c d\x85e", "a b a b a b a b", "w " * 70_000]:
        assert fingerprint(t.encode() if t else None) == slow_fingerprint(t)


def test_links_and_components(spark):
    import random

    pick = random.Random(3)
    base = [pick.getrandbits(64) for _ in range(20)]
    fps = {0}
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(pick.randrange(6)):
                x ^= 1 << pick.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(sorted((r.a, r.b))) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", None), (5, "one two three four", "x"), (5, "one two three four", "x"), (4, "ONE two three four", "x"), (None, "one two three four", "x")]
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect())
    assert got == sorted([("1", 1), ("2", 1), ("3", 1), ("5", 4), ("5", 4), ("4", 4), ("None", 4)])
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = slow_components(docs)
    got = op10_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in docs}
    assert {r.doc_id: r.component_id for r in got} == want


def test_keep_one(spark):
    rows = [(1, None, "x"), (2, "", "y"), (5, "one two three four", "x"), (5, "one two three four", "z"), (4, "ONE two three four", "x"), (4, "ONE two three four", "x"), (None, "one two three four", "x"), (None, "alone here", "q"), (9, "other words again", "q"), (9, "quite another text", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    docs = docs.withColumnRenamed("n", "source")
    got = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    assert got == sorted([(1, None), (4, "ONE two three four"), (None, "alone here"), (9, "other words again"), (9, "quite another text")], key=str)
    assert keep_one(docs.where("false")).collect() == []


def test_dissimilar_against_brute_force(spark):
    """Copies with edited words go, whatever group they are in: at least 0.97 of all that a comparison of all pairs finds, and no others."""
    import random

    pick = random.Random(12)
    word = lambda: "".join(pick.choices("abcdefghijkl", k=pick.randrange(2, 9)))
    texts = {}
    for k in range(0, 2000, 10):
        words = [word() for _ in range(pick.choice([30, 80, 250]))]
        texts[k] = " ".join(words)
        for j in range(1, pick.choice([1, 2, 4, 9])):
            rate = pick.choice([0.01, 0.03, 0.06, 0.3])
            texts[k + j] = " ".join(word() if pick.random() < rate else w.upper() if pick.random() < 0.1 else w for w in words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept, want = {r.doc_id for r in keep_dissimilar(docs).collect()}, set(slow_near(texts).values())
    gone, due = set(texts) - kept, set(texts) - want
    assert len(gone & due) >= 0.97 * len(due) > 100 and not gone - due


def test_dissimilar_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    due = set(texts) - set(slow_near(texts).values())
    gone = set(texts) - {r.doc_id for r in keep_dissimilar(docs).collect()}
    assert len(gone & due) >= 0.97 * len(due) > 100 and not gone - due


def test_dissimilar_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", "z"), (5, "one two", "x"), (5, "one two", "z"), (4, "ONE  two", "x"), (4, "ONE  two", "x"), (None, "one two", "x"), (None, "alone here", "q"), (None, "alone here", "q"), (9, "other words again", "q"), (9, "quite another text", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rk string").withColumnRenamed("text", "body")
    got = sorted(((r.doc_id, r.body) for r in keep_dissimilar(docs, text_col="body").collect()), key=str)
    assert got == sorted([(1, None), (4, "ONE  two"), (None, "alone here"), (9, "other words again"), (9, "quite another text")], key=str)
    assert keep_dissimilar(docs.where("false"), text_col="body").collect() == []


def test_segments_and_word_bits():
    assert segments_for(200_000)[0] == 29 and segments_for(10**10)[0] == 45
    bits = WordBits(100)
    bits.rows = 20
    many = " ".join(f"w{i}" for i in range(300)).encode()
    fresh = WordBits(100)
    assert (bits.of(many) == fresh.of(many)).all() and not bits.of(b"").any() and (bits.of(b"a b") == bits.of(b"B a a")).all()


def test_dissimilar_starts_few_jobs(spark):
    """A table of little but unlike texts of the same words needs few jobs, and each two texts of a bucket are tried."""
    import random

    pick = random.Random(5)
    line = " ".join(f"line{i}" for i in range(24))
    texts = {k: line + " " + " ".join(pick.choices(["the", "of", "and", "in", "to", "a", "is", "on"], k=4)) + f" {k} {k // 2}" for k in range(60)}
    texts |= {100 + k: " ".join(pick.choices(["the", "of", "and", "in", "to", "a", "is", "on"], k=60)) for k in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "near duplicates")
    kept = {r.doc_id for r in keep_dissimilar(docs).collect()}
    jobs = len(tracker.getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("other", "others")
    assert kept == set(slow_near(texts).values()) and jobs < 150, jobs

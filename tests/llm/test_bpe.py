import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import ByteBPE, digests, encode_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    return ByteBPE(PATH), Tokenizer.from_file(PATH)


def same(pair, text):
    ours, lib = pair
    ids = ours.encode(text)
    want = lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
    assert ours.decode(ids).decode() == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "it's we'll I'd", "a" * 20_000, "\x1c \x1fq\x85\xa0b​　", "<|endoftext|>a<|endoftext|> <|endoftext", "🎉👩‍👩‍👧 naïve é", "\x00\x01", "٣٤ ⅷ²", "1234567 12,345.67", "\r\n\t\v\f", "   x"])
def test_texts(pair, text):
    same(pair, text)


def test_random_texts(pair):
    pick = random.Random(7)
    for _ in range(400):
        kind = pick.choice(["th eainors", "aAbB '\n\t.,!?-_", None])
        same(pair, "".join(pick.choice(kind) if kind else chr(pick.choice([pick.randrange(32, 1000), pick.randrange(0x3000, 0x3100), pick.randrange(0x1F300, 0x1F6FF)])) for _ in range(pick.randrange(1, 200))))


def test_every_code_point_between_letters(pair):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    odd = 0
    for k in range(0, len(chars), 997):
        part = chars[k : k + 997]
        ours = [pair[0].encode(f"a{c}b {c}") for c in part]
        lib = pair[1].encode_batch([f"a{c}b {c}" for c in part], add_special_tokens=False)
        odd += sum(np.frombuffer(o, "<u4").tolist() != e.ids for o, e in zip(ours, lib, strict=True))
    assert odd == 0


def test_each_token_is_its_own_encoding(pair):
    bpe = pair[0]
    for r in range(0, 50_256, 11):
        s = "".join(chr(c) for c in bpe.bytes[bpe.id[r]])
        assert bpe.piece(s) == [r]


def test_tables(spark, pair):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (None, "", None), (1, "Hello world", "x"), (4, "a" * 300_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = digests(docs, PATH).collect()
    assert len(got) == 5
    want = sorted((str(k), hashlib.sha256((t or "").encode()).hexdigest(), len(pair[1].encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows)
    assert sorted((str(r.doc_id), r.decoded_sha256, r.n_tokens) for r in got) == want
    full = encode_table(docs, PATH)
    assert full.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in full.collect())
    assert digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_whole_table_against_the_library(spark, pair):
    from tidemark.llm.bpe import op6_bpe

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op6_bpe(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = pair[1].encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_caches_are_bounded_by_bytes(pair):
    """Long runs are not kept, many short pieces push out the older ones; ids stay those of the library."""
    pick, ours = random.Random(5), ByteBPE(PATH, limit_bytes=20_000)
    run = lambda n: "".join(pick.choices("abcdefXYZ", k=n))
    for _ in range(60):
        same((ours, pair[1]), " ".join([run(3000), "and", *(run(pick.randrange(1, 60)) for _ in range(100)), run(257), run(256)]))
        assert all(len(p) <= 256 for p in ours.known) and ours.held == sum(len(p) + len(v) for p, v in ours.known.items())
        assert ours.held + sum(map(len, ours.old)) < 140_000

import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm.token_files import Container, EliasFano, read_token_files, to_container, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 2, 900, 900, 70_000], list(range(0, 40_000, 7)), [10**9] * 600])
def test_elias_fano_get_and_all(values):
    ef = EliasFano.of(np.array(values, dtype=np.int64))
    assert ef.all().tolist() == values
    assert [ef.get(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.get(len(values))


def test_container_round_trip():
    docs = [[1, 2, 70_000], [], [3], [], [4] * 1000]
    box = Container(to_container(np.array(sum(docs, []), "<u4").tobytes(), np.cumsum([len(d) for d in docs])))
    assert [box.document(i).tolist() for i in range(len(docs))] == docs


TEXTS = [(3, "Hello, world. It's <|endoftext|> fine."), (1, None), (2, ""), (5, "Éá éco x\x1cy 12.5.,;   ΣΑΣ."), (4, "a" * 5000 + " b"), (3, "Hello, world. It's <|endoftext|> fine."), (None, "no id"), (9, "<|ENDOFTEXT|>. <|startoftext|>.")]


def test_files_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, part string")
    write_token_files(docs, f"file://{tmp_path}/t", PATH, container_ids=40)
    got = sorted(map(tuple, read_token_files(spark, f"file://{tmp_path}/t").select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    want = {k: [] for k, _ in TEXTS}
    for k, t in TEXTS:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[k].append((len(ids), zlib.crc32(ids.tobytes())))
    run = 0
    for (start, key, n, crc), key_wanted in zip(got, sorted((k for k, _ in TEXTS), key=lambda k: (k is not None, k)), strict=True):
        assert (start, key) == (run, key_wanted) and (n, crc) in want[key]
        run += n


def test_empty_table(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", PATH)
    assert read_token_files(spark, f"file://{tmp_path}/e").collect() == []


def test_whole_table_against_the_library(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.token_files import op3_token_files

    lib, sf = Tokenizer.from_file(PATH), "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op3_token_files(spark, sf).collect()}
    run = 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        ids = np.array([*lib.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        assert got[r["doc_id"]] == (run, len(ids), zlib.crc32(ids.tobytes()))
        run += len(ids)


def test_random_texts_with_a_small_cache():
    import random

    from tokenizers import Tokenizer

    from tidemark.llm.token_files import WordCache

    lib, cache, pick = Tokenizer.from_file(PATH), WordCache(PATH, limit=60), random.Random(9)
    kinds = ["abcXYZ", "aé̌ßΣİJ", "ab.,", "a1'st", "-_!?$#", "\x1c\x85\xa0 a", "漢字🎉"]
    for _ in range(60):
        texts = []
        for _ in range(pick.randrange(1, 6)):
            words = ["".join(pick.choices(pick.choice(kinds), k=pick.choice([1, 2, 3, 8, 9, 15, 16, 17, 40]))) + pick.choice(["", ".", ",", "..", "<|endoftext|>", "<|"]) * (pick.random() < 0.3) for _ in range(pick.randrange(30))]
            texts.append(pick.choice([None, "", " ", "x"]) if not words else "".join(w + pick.choice([" ", "\n", "\t ", "\r\n"]) for w in words))
        for t, ids in zip(texts, cache.encode([t if t is None else t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_cache_is_bounded_by_bytes():
    """Many long pieces are forgotten in time; ids stay those of the library."""
    import random

    from tokenizers import Tokenizer

    from tidemark.llm.token_files import WordCache

    lib, cache, pick = Tokenizer.from_file(PATH), WordCache(PATH, limit_bytes=30_000), random.Random(4)
    for _ in range(40):
        texts = [" ".join("".join(pick.choices("abcdef12+", k=pick.choice([3, 9, 40, 900]))) for _ in range(20)) for _ in range(5)]
        got = cache.encode([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert cache.long_bytes == sum(map(len, cache.long)) <= 30_000 + 100_000 and cache.pool.nbytes < 400_000

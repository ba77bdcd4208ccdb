"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A piece of text has exactly one encoding, and so has each of its prefixes; the encoding of a prefix is that of a shorter
prefix plus one last token. The automaton of all tokens (trie with suffix links) yields the tokens that end at each
byte; the one whose pair with the last token of the prefix before it is stable under the merges is the prefix's last
token. The stored last tokens are the back-pointers that give the ids. The work is linear in the text, however long a
piece is, where merging by rank is not.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, tidy

# Fixed value: the pattern that cuts text into pieces before the merges of this family of vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG = 256  # characters; a longer piece is encoded where it stands and not kept


def byte_names() -> dict[str, int]:
    """The printable character by which byte-level vocabularies name each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        names[chr(256 + k)] = b
    return names


class ByteBPE:
    """Encoder and decoder of a byte-level vocabulary file. Ranks number the bytes first, then the merges in order."""

    def __init__(self, path: str, limit: int = 120_000, limit_bytes: int = 16 << 20):
        import ahocorasick
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        names = byte_names()
        tokens = [*names, *(a + b for a, b in merges)]
        rank = {t: i for i, t in enumerate(tokens)}
        if len(rank) != len(tokens):
            raise ValueError("two merges make the same token")
        self.left, self.right, self.pair = list(range(256)), list(range(256)), {}
        for i, (a, b) in enumerate(merges, 256):
            self.left.append(rank[a])
            self.right.append(rank[b])
            self.pair[rank[a], rank[b]] = i
        strings = ["".join(chr(names[c]) for c in t) for t in tokens]  # a byte is the character of its number
        self.length, self.id = [len(s) for s in strings], [vocab[t] for t in tokens]
        self.bytes = {vocab[t]: s.encode("latin-1") for t, s in zip(tokens, strings, strict=True)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.automaton = ahocorasick.Automaton()
        for i, s in enumerate(strings):
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.cut = regex.compile(PIECES)
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.stable: dict[int, bool] = {}
        # pieces already encoded, in two generations bounded by number and bytes: what is still met moves to the young one
        self.limit, self.limit_bytes, self.known, self.old, self.held = limit, limit_bytes, {}, {}, 0

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges leave token a followed by token b as they are?

        Both tokens are unmade step by step, the later merge first. At each step the two parts that touch must not have
        a merge that comes before those already unmade, or the merges would have joined them across the border.
        """
        left, right, pair = self.left, self.right, self.pair
        before = len(left)  # merges that come before this rank would have been taken first
        while True:
            joined = pair.get((a, b))
            if joined is not None and joined < before:
                return False
            if a <= b:
                if b >= 256:
                    before, b = b + 1, left[b]
                    continue
                if a < 256:
                    return True
                before, a = a, right[a]
            else:
                if a >= 256:
                    before, a = a, right[a]
                    continue
                if b < 256:
                    return True
                before, b = b + 1, left[b]

    def piece(self, piece: str) -> list[int]:
        """Ranks of one piece, given as a string of byte-valued characters."""
        last = [-1] * (len(piece) + 1)
        stable = self.stable
        for at, (token, n) in self.automaton.iter(piece):
            end = at + 1
            if last[end] >= 0:
                continue
            if n == end:
                last[end] = token
                continue
            before = last[end - n]
            if before < 0:
                continue
            key = before << 20 | token
            ok = stable.get(key)
            if ok is None:
                ok = stable[key] = self.compatible(before, token)
            if ok:
                last[end] = token
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= self.length[last[end]]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        if self.at_special is not None and any(t in text for t in self.special):
            return b"".join(np.array([self.special[part]], "<u4").tobytes() if k % 2 else self._plain(part) for k, part in enumerate(self.at_special.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known, pieces = self.known, self.cut.findall(text)
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > self.limit or self.held > self.limit_bytes:
            # one text can bring more than a generation: that is not kept
            self.old = known if self.held <= 2 * self.limit_bytes else {}
            self.known = known = {}
            self.held = 0
        if len(self.stable) > 2 * self.limit:
            self.stable.clear()
        ids, old, once = self.id, self.old, {}
        for p in pieces:
            if p not in known and p not in once:
                made = old.get(p) or np.array([ids[r] for r in self.piece(p.encode().decode("latin-1"))], "<u4").tobytes()
                if len(p) > LONG:
                    once[p] = made
                else:
                    known[p] = made
                    self.held += len(p) + len(made)
        return b"".join([known.get(p) or once[p] for p in pieces] if once else map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no character become the replacement character."""
        raw = b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I").tolist()))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBPE:
    """One for each Python worker: later tasks find the pieces of earlier ones."""
    return ByteBPE(path)


def encode_table(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Every row with n_tokens long, ids binary (LE u32) and decoded string appended; a null text counts as empty.

    Columns of docs with these names are replaced. Rows are independent: no shuffle, one pass, any length of text.
    """
    arrow_limits(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("n_tokens", "ids", "decoded")]
    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    at = [f.name for f in kept].index(text_col)

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for b in blocks:
            ids = [bpe.encode(t) if t else b"" for t in b.column(at).to_pylist()]
            decoded = [bpe.decode(x) for x in ids]
            cols = [*b.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(tidy(run), schema)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Digest form of encode_table: the digests are taken beside the encoding, so ids and texts do not travel back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    arrow_limits(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for b in blocks:
            ids = [bpe.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

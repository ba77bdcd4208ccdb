"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once.

A node is a turn together with all turns before it. Conversations are ordered by their paths of node keys, which puts
those that share turns side by side; a node belongs to the first conversation in that order that has it, so nodes in the
order of (conversation, depth) are the tree depth first. The output is that sequence of tokens (code points of the
formatted turns) in one row a node: where its tokens start in the sequence, the position id of its first token (its
place in its own conversations), the stretches of the sequence that hold its ancestors (what its tokens may attend to
besides their own node), and its loss mask. A second table has each conversation's nodes.

The order is worked out on node keys and lengths alone. Texts move twice: to their conversation, where they are formatted and
hashed, and to their place in the tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, batches, joined_by, tidy, written

# The template.
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("### ", "#\\## ")]  # taken in this order
ROLE_ESCAPES = [*ESCAPES, (":", "\\:")]
LOSS_ROLE = "assistant"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.S)


def escape(text: str, rules: list[tuple[str, str]] = ESCAPES) -> str:
    for raw, safe in rules:
        text = text.replace(raw, safe)
    return text


def unescape(text: str) -> str:
    """A control string inside a text is broken by a backslash, and a backslash is doubled: drop the first of each two."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def keyed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> a row a turn: conv_id, idx, node, segment, n, loss_lo, loss_hi, pos, path.

    Turns follow each other by turn, then role and text. path, on a conversation's last turn, is the keys of its nodes.
    """
    made = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    made = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("idx", pa.int64()), ("node", pa.binary()), ("segment", pa.string()), ("n", pa.int64()), ("loss_lo", pa.int32()), ("loss_hi", pa.int32()), ("pos", pa.int64()), ("path", pa.binary())])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now: tuple | None = None
            last, path, idx, pos, node = None, [], 0, 0, b""
            for b in blocks:
                for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    head, body = f"{OPEN}{escape(role, ROLE_ESCAPES)}{BETWEEN}", escape(text)
                    segment, lo = head + body + CLOSE, len(head)
                    hi = lo + len(body) if role == LOSS_ROLE else lo
                    if last is not None and now != (conv,):
                        yield (*last, b"".join(path))
                        last, path, idx, pos, node = None, [], 0, 0, b""
                    elif last is not None:
                        yield (*last, None)
                    now = (conv,)
                    node = hashlib.blake2b(node + segment.encode(), digest_size=16).digest()
                    path.append(node[:12])
                    last = (conv, idx, node, segment, len(segment), lo, hi, pos)
                    idx, pos = idx + 1, pos + len(segment)
            if last is not None:
                yield (*last, b"".join(path))

        yield from batches(out(), schema, 2048)

    return made.mapInArrow(tidy(run), "conv_id long, idx long, node binary, segment string, n long, loss_lo int, loss_hi int, pos long, path binary")


def own_nodes(paths: DataFrame) -> DataFrame:
    """paths in the order of (conv_id, idx) -> the rows that are own, with the stretches of their ancestors."""
    interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([*((n, pa.int64()) for n in ("conv_id", "idx", "start", "n", "pos", "refs")), ("ancestors", interval)])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now: tuple | None = None
            above: list[dict] = []
            for b in blocks:
                for conv, idx, start, n, pos, refs, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if now != (conv,):
                        now, above = (conv,), []
                    if own:
                        yield conv, idx, start, n, pos, refs, [dict(x) for x in above]
                    if above and above[-1]["end"] == start:
                        above[-1]["end"] += n
                    else:
                        above.append({"start": start, "end": start + n})

        yield from batches(out(), schema, 2048)

    rows = paths.repartition("conv_id").sortWithinPartitions("conv_id", "idx").select("conv_id", "idx", "start", "n", "pos", "refs", "own")
    return rows.mapInArrow(tidy(run), "conv_id long, idx long, start long, n long, pos long, refs long, ancestors array<struct<start:long,end:long>>")


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations(conv_id, turn, role, text) -> (nodes, paths).

    nodes: start, n, pos, segment, loss_lo, loss_hi, ancestors, and which turn (conv_id, idx) gave the segment and how many
    conversations have it (refs). paths: conv_id, idx, start, own (the segment is from this turn), refs.
    Null roles and texts count as empty; rows of a null conv_id are one conversation; rows of one turn follow each other
    by role and text, repeated rows are turns of their own. Nothing is gathered but one path (12 bytes a turn) and
    the counts of the write's partitions; a turn that many conversations start with is a row a task in the aggregates.
    """
    spark = conversations.sparkSession
    arrow_limits(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = written(keyed(conversations.select("conv_id", "turn", "role", "text")), "chat-turns")
    order = turns.where("path is not null").select("conv_id", "path").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    order = written(order.select("conv_id", F.monotonically_increasing_id().alias("ord")), "chat-order")
    light = turns.select("conv_id", "idx", "node", "n", "pos")
    placed = written(light.alias("t").join(order.alias("o"), F.col("t.conv_id").eqNullSafe(F.col("o.conv_id"))).select("t.*", "ord"), "chat-placed")
    first = placed.groupBy("node").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("refs"))
    # a node is once in a conversation
    nodes = placed.join(first, ["node", "ord"]).select("ord", "idx", "node", "n", "refs")
    nodes = nodes.repartitionByRange(parts, "ord", "idx").sortWithinPartitions("ord", "idx").withColumn("part", F.spark_partition_id())
    nodes = written(nodes, "chat-nodes")
    base, run = [], 0
    for r in sorted(nodes.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base.append((r["part"], run))
        run += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))  # a row a partition
    inner = Window.partitionBy("part").orderBy("ord", "idx").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(bases, "part").withColumn("start", F.col("before") + F.col("base"))
    nodes = written(nodes.select("node", F.col("ord").alias("first"), "start", "refs"), "chat-starts")
    walk = joined_by(placed, nodes, ["node"], "refs", placed.count())
    paths = written(walk.select("conv_id", "idx", "start", "n", "pos", "refs", (F.col("ord") == F.col("first")).alias("own")), "chat-paths")
    own = own_nodes(paths).alias("p")
    same = F.col("t.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("t.idx") == F.col("p.idx"))
    tree = turns.select("conv_id", "idx", "segment", "loss_lo", "loss_hi").alias("t").join(own, same)
    tree = tree.select("p.start", "p.n", "p.pos", "t.segment", "t.loss_lo", "t.loss_hi", "p.ancestors", "p.conv_id", "p.idx", "p.refs")
    return written(tree.sortWithinPartitions("start"), "chat-tree"), paths.select("conv_id", "idx", "start", "own", "refs")


SHARED_ROWS = 10_000  # conversations that meet one copy of a shared turn


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Digests of every conversation from its nodes: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    positions_sha256 (of the comma-joined position ids of its turns' first tokens), ancestor_chars (the tokens that the
    ancestors of its turns hold, summed over the turns)."""
    above = F.aggregate("ancestors", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("above")
    columns = ["conv_id", "idx", "segment", "loss_lo", "loss_hi", "pos", "above"]
    own = nodes.select("conv_id", "idx", "segment", "loss_lo", "loss_hi", "pos", above)
    # only turns that several conversations share are joined; one that very many share is there in several copies
    copies = F.ceil(F.col("refs") / SHARED_ROWS).cast("int")
    shared = nodes.where("refs > 1").select("start", "segment", "loss_lo", "loss_hi", "pos", above, F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    asked = paths.where("not own").select("conv_id", "idx", "start", F.pmod(F.xxhash64("conv_id", "idx"), copies).cast("int").alias("copy"))
    rows = own.unionByName(asked.join(shared, ["start", "copy"]).select(*columns))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "idx")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("positions_sha256", pa.string()), ("ancestor_chars", pa.int64())])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now: tuple | None = None
            for b in blocks:
                for conv, _, segment, lo, hi, pos, ancestors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if now != (conv,):
                        if now is not None:
                            yield now[0], n, turns.hexdigest(), loss, masked.hexdigest(), chars, places.hexdigest(), around
                        now, n, loss, chars, around, turns, masked, places = (conv,), 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                    role, text = TURN.fullmatch(segment).groups()
                    under = unescape(segment[lo:hi])
                    turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    masked.update(under.encode())
                    places.update(f"{',' if n else ''}{pos}".encode())
                    n, loss, chars, around = n + 1, loss + len(under), chars + len(segment), around + ancestors
            if now is not None:
                yield now[0], n, turns.hexdigest(), loss, masked.hexdigest(), chars, places.hexdigest(), around

        yield from batches(out(), schema)

    return rows.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, positions_sha256 string, ancestor_chars long")


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(*prefix_tree(rows.unionByName(more)))

"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents of equal text are linked. A group of linked documents is kept as counts, one for each shard that holds some of
it, so a group is at most one row a shard however many copies it has. From a balanced start, each round moves linked
documents towards the shard with most of their neighbours: every shard takes the moves of the highest gain up to its
quota, which is its share of all rows less the linked rows it has. Documents without links fill the shards up to
their shares, so the counts of the shards are at most one apart (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import positions, written

KEY = ["k1", "k2"]
ROUNDS = 8


def running(df: DataFrame, group: str, level: Column, order: list[Column], value: str, parts: int) -> DataFrame:
    """Add _before: the sum of value over the rows of the group that come earlier, by level, then hash part, then order.

    Sums of (group, level, part) meet in one window; the rows themselves only within their part.
    """
    df = df.withColumn("_level", level).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    keys = [group, "_level", "_part"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(group).orderBy("_level", "_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return inside.join(sums, keys).withColumn("_before", F.col("_base") + F.col("_inner")).drop("_level", "_part", "_base", "_inner")


def pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)


def propagate(groups: DataFrame, quotas: list[int], parts: int, rounds: int = ROUNDS) -> DataFrame:
    """groups(k1, k2, n) of linked documents -> (k1, k2, shard, c): how many of each group every shard holds.

    Linked documents start in blocks: all groups in the order of their hash, cut into even parts. In a round a group
    draws together in the fewest of its shards that could hold it with the room they have, those with most of it first.
    """
    shards, total = len(quotas), groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = running(groups.withColumn("_all", F.lit(0)), "_all", F.lit(0), [F.col(c) for c in KEY], "n", parts)
    cuts, end = [], 0
    for s in range(shards):
        start, end = end, end + total // shards + (s < total % shards)
        inside = F.least(F.col("_before") + F.col("n"), F.lit(end)) - F.greatest(F.col("_before"), F.lit(start))
        cuts.append(F.struct(F.lit(s).alias("shard"), inside.cast("long").alias("c")))
    state = placed.select(*KEY, F.explode(F.filter(F.array(*cuts), lambda x: x["c"] > 0)).alias("x")).select(*KEY, "x.shard", "x.c")
    state = written(state, "shards-0")
    for k in range(1, rounds + 1):
        loads = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.sum("c").alias("c")).collect()}
        free = [max(0, q - loads.get(s, 0)) for s, q in enumerate(quotas)]
        # at most one row a shard meets in these windows and arrays
        ranked = Window.partitionBy(*KEY).orderBy(F.desc("c"), F.xxhash64(*KEY, "shard"), "shard")
        earlier = ranked.rowsBetween(Window.unboundedPreceding, -1)
        seen = state.withColumn("room", pick(free, F.col("shard"))).withColumn("n", F.sum("c").over(Window.partitionBy(*KEY)))
        seen = seen.withColumn("stays", F.coalesce(F.sum(F.col("c") + F.col("room")).over(earlier), F.lit(0)) < F.col("n"))
        seen = seen.withColumn("open_before", F.coalesce(F.sum(F.when(F.col("stays"), F.col("room")).otherwise(0)).over(earlier), F.lit(0)))
        seen = seen.withColumn("gone_before", F.coalesce(F.sum(F.when(F.col("stays"), 0).otherwise(F.col("c"))).over(earlier), F.lit(0)))
        to = seen.where("stays and room > 0").groupBy(*KEY).agg(F.collect_list(F.struct(F.col("shard").alias("to"), F.col("c").alias("there"), F.col("open_before").alias("lo"), (F.col("open_before") + F.col("room")).alias("hi"))).alias("targets"))
        wishes = seen.where("not stays").join(to, KEY).select(*KEY, "shard", "c", "gone_before", F.explode("targets").alias("t"))
        amount = F.least(F.col("t.hi"), F.col("gone_before") + F.col("c")) - F.greatest(F.col("t.lo"), F.col("gone_before"))
        moves = wishes.select(*KEY, "shard", F.col("t.to").alias("to"), (F.col("t.there") - F.col("c")).alias("gain"), amount.alias("wish")).where("wish > 0")
        level = 64 - F.floor(F.log2(F.col("gain") + 1)).cast("int")
        queued = running(moves, "to", level, [*[F.col(c) for c in KEY], F.col("shard")], "wish", parts)
        taken = F.greatest(F.lit(0), F.least(F.col("wish"), pick(free, F.col("to")) - F.col("_before")))
        made = written(queued.withColumn("taken", taken.cast("long")).where("taken > 0").select(*KEY, "shard", "to", "taken"), f"moves-{k}")
        if not made.limit(1).count():
            break
        change = made.select(*KEY, F.explode(F.array(F.struct(F.col("shard"), (-F.col("taken")).alias("c")), F.struct(F.col("to").alias("shard"), F.col("taken").alias("c")))).alias("x")).select(*KEY, "x.shard", "x.c")
        state = written(state.unionByName(change).groupBy(*KEY, "shard").agg(F.sum("c").alias("c")).where("c > 0"), f"shards-{k}")
    return state


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus one (null counts as empty, and is linked like it). Every row is kept; rows
    of one id and repeated rows are documents of their own. slot numbers a shard's documents from 0. The text is read
    once; what is shuffled is 40 bytes a row. No group or shard is a task: ranks come from counts of hash parts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("k1"), F.shiftleft(crc, 32).bitwiseOR(F.hash(text).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("k2"))
    rows = written(rows, "rows")
    groups = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    state = propagate(groups.where("n > 1"), quotas, parts)
    loads = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.sum("c").alias("c")).collect()}
    ends, end = [], 0
    for s, q in enumerate(quotas):
        end += q - loads.get(s, 0)
        ends.append(end)
    # a group's documents take its places in the shards in the order of their rank
    upto = Window.partitionBy(*KEY).orderBy("shard")
    places = state.withColumn("hi", F.sum("c").over(upto)).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("places"))
    order = [F.xxhash64("doc_id", *KEY), F.col("doc_id")]
    linked, single = (rows.join(groups.where(w).select(*KEY), KEY, "left_semi") for w in ("n > 1", "n = 1"))
    linked = written(linked, "linked")
    # the places join the counts of (group, part), never the documents by group alone
    linked = linked.withColumn("_part", F.pmod(order[0], F.lit(parts)).cast("int"))
    keys = [*KEY, "_part"]
    before = Window.partitionBy(*KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).select(*keys, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    starts = starts.join(places, KEY)
    ranked = linked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    at = F.col("base") + F.col("rank")
    put = ranked.join(starts, keys).withColumn("shard", F.filter("places", lambda p: p["hi"] > at)[0]["shard"])
    alone = positions(single, [], order, "at", parts)
    where = F.coalesce(*[F.when(F.col("at") < e, F.lit(s)) for s, e in enumerate(ends)])
    columns = ["doc_id", "size", "text_crc32", *KEY]
    both = written(put.select(*columns, "shard").unionByName(alone.withColumn("shard", where).select(*columns, "shard")), "assigned")
    out = positions(both, ["shard"], order, "slot", parts)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))

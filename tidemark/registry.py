"""Queries over the driver's tables and the SQL that gives the same rows.

The events table is the history: key user_id, sequence number event_id, a delete where event_type is 'error', else a
put of value. String keys are event_type/user_id. Files are ranges of event_id with the keys they hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import errors, workspace
from tidemark.functions import bloom, keys
from tidemark.operators import compaction, reads
from tidemark.operators.reads import ChangeLog
from tidemark.options import Options
from tidemark.plans import manifest
from tidemark.sources import editlog, journal, tablefile
from tidemark.sources.store import Store
from tidemark.streaming import ingest
from tidemark.workspace import shared_dir

def kt():
    return F.when(F.col("event_type") == "error", 2).otherwise(1)


V = "v as (select user_id as k, event_id as seq, case when event_type = 'error' then 2 else 1 end as kt, value as val from events)"
NEWEST = "newest as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from v) where rn = 1)"
FILES = "files as (select event_id // 500 as num, (event_id // 500) % 3 as level, count(*) as size, min(user_id % 97) as min_key, max(user_id % 97) as max_key, min(event_id) as min_seq, max(event_id) as max_seq from events where (event_id // 500) % 3 > 0 or user_id % 97 < 40 + (event_id // 500) group by 1, 2)"
EDITS = "edits as (select o_orderkey // 16 as step, o_orderkey as ord, case when o_orderstatus = 'F' then 'del' else 'add' end as action, cast(o_orderkey % 3 as integer) as level, o_custkey % 200 as num, cast(o_totalprice as bigint) as size from orders)"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def history(spark: SparkSession, sf: str) -> ChangeLog:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), kt().alias("kt"), F.col("value").alias("val"))
    return ChangeLog(rows, ("k",))


def string_history(spark: SparkSession, sf: str) -> ChangeLog:
    rows = table(spark, sf, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("k"), F.col("event_id").alias("seq"), F.lit(1).alias("kt"), F.col("value").alias("val"))
    return ChangeLog(rows, ("k",))


def files(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("num", F.floor(F.col("event_id") / 500)).withColumn("level", F.col("num") % 3).withColumn("key", F.col("user_id") % 97)
    e = e.where((F.col("level") > 0) | (F.col("key") < 40 + F.col("num")))
    return e.groupBy("num", "level").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("event_id").alias("min_seq"), F.max("event_id").alias("max_seq"))


def edits(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 16).alias("step"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", "del").otherwise("add").alias("action"), (F.col("o_orderkey") % 3).cast("int").alias("level"), (F.col("o_custkey") % 200).alias("num"), F.rint("o_totalprice").cast("long").alias("size"))


# ---- point reads, scans, snapshots


@query(f"with {V}, {NEWEST} select k, seq, val from newest where kt = 1")
def snapshot_latest(spark, sf):
    return history(spark, sf).live()


@query(f"with {V}, w as (select *, row_number() over (partition by k order by seq desc) as rn from v where seq <= 500) select k, seq, val from w where rn = 1 and kt = 1")
def snapshot_at(spark, sf):
    return history(spark, sf).live(500)


@query(f"with {V} select k, seq, val from v where k = 7 and kt = 1 and seq = (select max(seq) from v where k = 7)")
def get_one(spark, sf):
    return history(spark, sf).get(7)


@query(f"with {V}, {NEWEST} select k, seq from newest where kt = 2")
def tombstones_at_head(spark, sf):
    return history(spark, sf).deleted()


@query(f"with {V}, {NEWEST}, asked as (select c_custkey as k from customer where c_custkey % 3 = 0) select a.k, n.seq, n.val from asked a left join (select * from newest where kt = 1) n on a.k = n.k")
def multi_get_left(spark, sf):
    asked = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return history(spark, sf).multi_get(asked)


@query(f"with {V}, {NEWEST}, asked as (select c_custkey as k from customer where c_custkey % 3 = 0) select a.k, n.seq, n.val from asked a join (select * from newest where kt = 1) n on a.k = n.k")
def multi_get_hits(spark, sf):
    asked = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return history(spark, sf).multi_get(asked, how="inner")


@query(f"with {V}, probes as (select distinct user_id as k, event_id // 3 as snap from events where event_type = 'purchase'), hit as (select p.k, p.snap, v.seq, v.kt, v.val, row_number() over (partition by p.k, p.snap order by v.seq desc) as rn from probes p left join v on v.k = p.k and v.seq <= p.snap) select k, snap, case when kt = 1 then seq end as seq, case when kt = 1 then val end as val from hit where rn = 1")
def as_of_get(spark, sf):
    probes = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.floor(F.col("event_id") / 3).alias("snap")).distinct()
    return history(spark, sf).as_of(probes, "snap")


@query(f"with {V}, {NEWEST} select k, seq, val from newest where kt = 1 and k >= 42 order by k limit 1")
def find_ge(spark, sf):
    return history(spark, sf).find_ge(42)


@query(f"with {V}, {NEWEST} select k, seq, val from newest where kt = 1 and k >= 10 order by k limit 25")
def seek_limit(spark, sf):
    return history(spark, sf).seek(10, 25)


@query(f"with {V}, {NEWEST} select k, seq, val from newest where kt = 1 and k >= 20 and k < 60")
def range_scan(spark, sf):
    return history(spark, sf).range(20, 60)


@query("with v as (select event_type || '/' || user_id as k, event_id as seq, value as val from events), n as (select *, row_number() over (partition by k order by seq desc) as rn from v) select k, seq, val from n where rn = 1 and k like 'click/1%'")
def prefix_scan(spark, sf):
    return string_history(spark, sf).prefix("click/1")


@query(f"with {V}, {NEWEST} select k, seq from newest where kt = 1")
def keys_only(spark, sf):
    return history(spark, sf).keys_only()


@query(f"with {V}, {NEWEST} select count(*) as n_live from newest where kt = 1")
def count_live(spark, sf):
    return history(spark, sf).keys_only().agg(F.count(F.lit(1)).alias("n_live"))


@query("select o_custkey as k, max(o_orderkey) as seq, max_by(o_totalprice, o_orderkey) as val from orders group by o_custkey having max_by(o_orderstatus, o_orderkey) <> 'F'")
def snapshot_orders(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("kt"), F.col("o_totalprice").alias("val"))
    return ChangeLog(o, ("k",)).live()


# ---- layers, merges, orders


@query(f"with {V} select k, seq, kt, val from v")
def merge_runs(spark, sf):
    log = history(spark, sf)
    runs = [log.df.where(F.col("seq") % 4 == i) for i in range(4)]
    return reads.merged(runs, reads.internal_order("k"))


@query(f"with {V} select k, seq, kt, row_number() over (order by k, seq desc, kt desc) as place from v")
def merge_runs_in_order(spark, sf):
    """The places of the merged rows: where the sorted output has them, partition after partition."""
    log = history(spark, sf)
    runs = [log.df.where(F.col("seq") % 4 == i) for i in range(4)]
    out = reads.merged(runs, reads.internal_order("k")).select("k", "seq", "kt", F.monotonically_increasing_id().alias("at"))
    return reads.assign_sequence(out, ["at"], 0, name="place").drop("at")


@query(f"with {V}, {NEWEST} select k, seq, val from newest where kt = 1")
def layered_lookup(spark, sf):
    df = history(spark, sf).df
    top = df.agg(F.max("seq")).first()[0]
    cuts = [-1, top // 2, top * 3 // 4, top]
    layers = [df.where((F.col("seq") > a) & (F.col("seq") <= b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return reads.layered(layers[::-1], "k")


@query(f"with {V} select k, max(seq) as seq, max_by(seq // 500, seq) as num from v group by k")
def l0_arbitration_all(spark, sf):
    return ChangeLog(history(spark, sf).df.withColumn("num", F.floor(F.col("seq") / 500)), ("k",)).newest().select("k", "seq", "num")


@query(f"with {V} select k, seq, row_number() over (partition by k order by seq desc, kt desc) as place from v")
def internal_order(spark, sf):
    w = Window.partitionBy("k").orderBy(*reads.internal_order("k")[1:])
    return history(spark, sf).df.select("k", "seq", F.row_number().over(w).alias("place"))


@query("select c_custkey, c_name, row_number() over (order by c_name, c_custkey) as place from customer")
def user_key_order_all(spark, sf):
    return reads.assign_sequence(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 0, name="place")


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 15")
def heap_top_k(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return reads.top_k(df, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 15)


@query("select o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') as in_order from orders group by o_custkey")
def merge_sort_all(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))).alias("in_order"))


@query("with p as (select p_partkey, p_size as probe from part) select p_partkey, cast(case when probe % 2 = 1 and probe <= 49 then (probe - 1) // 2 else -(least(25, probe // 2) + 1) end as integer) as place from p")
def binary_search(spark, sf):
    odd = F.array(*[F.lit(i) for i in range(1, 50, 2)])
    return table(spark, sf, "part").select("p_partkey", reads.binary_search(odd, F.col("p_size")).alias("place"))


@query("select event_id, 1000 + row_number() over (order by event_id) as seq from events where event_type <> 'view'")
def sequence_assignment(spark, sf):
    rows = table(spark, sf, "events").where("event_type <> 'view'").select("event_id")
    return reads.assign_sequence(rows, ["event_id"], 1000)


@query("select o_custkey, 10 * o_custkey + row_number() over (partition by o_custkey order by o_orderkey) - 1 as seq, o_orderkey from orders")
def batch_entries(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey"))).alias("entries"))
    return reads.exploded_batch(o.withColumn("base", F.col("o_custkey") * 10), "entries", "base")


@query(f"with {V} select k, seq, kt, val from v where false")
def empty_scan(spark, sf):
    df = history(spark, sf).df
    return compaction.empty(spark, df.schema)


# ---- compaction filter


GC = "gc as (select *, lag(seq) over (partition by k order by seq desc) as newer from v)"


@query(f"with {V}, {GC} select k, seq, kt, val from gc where newer is null or newer > 500")
def gc_versions(spark, sf):
    return compaction.drop_shadowed(history(spark, sf).df, 500, "k")


@query(f"with {V}, {GC} select k, seq, kt, val from gc where (newer is null or newer > 500) and not (kt = 2 and seq <= 500)")
def gc_full(spark, sf):
    return compaction.compacted(history(spark, sf).df, 500, key="k")


DEEP = "deep as (select o_custkey // 40 as num, min(o_custkey) as min_key, min(o_custkey) + 12 as max_key from orders group by 1)"


@query(f"with {V}, {GC}, {DEEP} select k, seq, kt, val from gc where (newer is null or newer > 900) and not (kt = 2 and seq <= 900 and not exists (select 1 from deep where k between min_key and max_key))")
def gc_base_level_anti(spark, sf):
    deep = table(spark, sf, "orders").groupBy(F.floor(F.col("o_custkey") / 40).alias("num")).agg(F.min("o_custkey").alias("min_key"), (F.min("o_custkey") + 12).alias("max_key"))
    return compaction.compacted(history(spark, sf).df, 900, deep, key="k")


@query("select coalesce(min(event_id), 999999) as min_seq from events where event_type = 'purchase' and event_id > 400")
def min_live_snapshot(spark, sf):
    held = table(spark, sf, "events").where("event_type = 'purchase' and event_id > 400").select(F.col("event_id").alias("seq"))
    return compaction.min_live(held, 999999)


@query(f"with {V}, w as (select *, row_number() over (partition by k order by seq desc) as rn from v where seq <= 700) select k, seq, val from w where rn = 1 and kt = 1")
def read_after_gc(spark, sf):
    log = history(spark, sf)
    return log.over(compaction.compacted(log.df, 500, key="k")).live(700)


# ---- files, levels, manifest


@query(f"with {FILES} select * from files")
def file_stats(spark, sf):
    return files(spark, sf)


@query(f"with {FILES} select level, count(*) as n_files, cast(sum(size) as bigint) as bytes from files group by level")
def level_counts(spark, sf):
    return manifest.level_stats(files(spark, sf))


@query(f"with {FILES} select cast(sum(size) as bigint) as total from files")
def table_size_sum(spark, sf):
    return manifest.level_stats(files(spark, sf)).agg(F.sum("bytes").alias("total"))


@query(f"with {FILES} select level, case when level = 0 then count(*) / 12.0::double else sum(size) / (1000.0::double * 10 ** level) end as score from files group by level")
def level_score(spark, sf):
    return manifest.level_scores(files(spark, sf), Options(level_base=1000))


@query(f"with {FILES}, s as (select level, case when level = 0 then count(*) / 12.0::double else sum(size) / (1000.0::double * 10 ** level) end as score from files group by level) select level, score, score >= 1 as needed from s order by score desc, level limit 1")
def need_compaction(spark, sf):
    return manifest.best_level(manifest.level_scores(files(spark, sf), Options(level_base=1000)))


@query(f"with {FILES} select num, level, size, min_key, max_key, min_seq, max_seq from files where min_key <= 60 and max_key >= 50")
def overlap_range(spark, sf):
    return manifest.overlaps(files(spark, sf), 50, 60)


@query("with f as (select o_orderkey // 64 as num, min(o_custkey) as min_key, min(o_custkey) + count(*) % 7 as max_key from orders group by 1) select a.num as a, b.num as b from f a join f b on a.num < b.num and a.min_key <= b.max_key and b.min_key <= a.max_key")
def overlap_files(spark, sf):
    f = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 64).alias("num")).agg(F.min("o_custkey").alias("min_key"), (F.min("o_custkey") + F.count(F.lit(1)) % 7).alias("max_key"))
    return manifest.overlap_pairs(f)


@query("with r as (select c_custkey * 7 % 9973 as min_key, c_custkey * 7 % 9973 + c_nationkey % 5 as max_key from customer), m as (select *, max(max_key) over (order by min_key, max_key rows between unbounded preceding and 1 preceding) as reach from r), i as (select *, sum(case when reach is null or min_key > reach then 1 else 0 end) over (order by min_key, max_key rows unbounded preceding) as island from m) select cast(island as bigint) as island, min(min_key) as min_key, max(max_key) as max_key, count(*) as n from i group by 1")
def l0_expand_islands(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") * 7 % 9973).alias("min_key"), (F.col("c_custkey") * 7 % 9973 + F.col("c_nationkey") % 5).alias("max_key"))
    return compaction.islands(c, "min_key", "max_key")


@query(f"with {FILES} select min(min_key) as low, max(max_key) as high from files")
def range_union(spark, sf):
    held = [manifest.File(r["level"], r["num"], r["size"], r["min_key"], r["max_key"]) for r in files(spark, sf).collect()]  # a row a file
    return spark.createDataFrame([manifest.hull(held)], "low long, high long")


@query(f"with {FILES}, r as (select *, row_number() over (partition by level order by max_key, num) as n from files where max_key >= 90 and level > 0) select num, level from files where level = 0 and min_key <= 90 and max_key >= 90 union all select num, level from r where n = 1 and min_key <= 90")
def candidate_walk(spark, sf):
    w = Window.partitionBy("level").orderBy("max_key", "num")
    f = files(spark, sf)
    # files of one level have distinct greatest keys in a real version; here ties go to the lower number
    single = f.where("level > 0 and max_key >= 90").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return manifest.candidates(f.where("level = 0").unionByName(single), 90).select("num", "level")


@query("with f as (select o_orderkey // 100 as num, max(o_orderkey) as max_key from orders group by 1) select num, max_key from f where max_key >= 777 order by max_key limit 1")
def array_indexer(spark, sf):
    f = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("num")).agg(F.max("o_orderkey").alias("max_key"))
    return manifest.first_reaching(f, 777)


@query(f"with {EDITS}, l as (select *, row_number() over (partition by step, level, num order by ord desc) as n, max(case when action = 'add' then 1 else 0 end) over (partition by step, level, num) as added from edits) select step, ord, action, level, num from l where n = 1 and not (action = 'del' and added = 1)")
def edit_netting(spark, sf):
    return manifest.netted(edits(spark, sf)).select("step", "ord", "action", "level", "num")


@query(f"with {EDITS}, l as (select *, row_number() over (partition by level, num order by step desc, ord desc) as n from edits) select level, num from l where n = 1 and action = 'add'")
def manifest_fold(spark, sf):
    return manifest.folded(edits(spark, sf)).select("level", "num")


@query(f"with {EDITS}, l as (select *, row_number() over (partition by level, num order by step desc, ord desc) as n from edits where step <= 30) select level, num from l where n = 1 and action = 'add'")
def manifest_at_version(spark, sf):
    return manifest.folded(edits(spark, sf), 30).select("level", "num")


@query(f"with {EDITS} select max_by(size, ord) filter (action = 'add') as size, max_by(num, ord) as num from edits")
def manifest_scalars(spark, sf):
    e = edits(spark, sf).withColumn("size", F.when(F.col("action") == "add", F.col("size")))
    return manifest.scalars(e, ["size", "num"])


@query("with f as (select o_custkey * 7 + o_orderkey % 7 as num, o_orderstatus as s from orders), o as (select distinct num from f where s <> 'O'), n as (select distinct num from f where s <> 'F') select 'add' as action, num from (select num from n except select num from o) union all select 'del' as action, num from (select num from o except select num from n)")
def version_delta_all(spark, sf):
    f = table(spark, sf, "orders").select((F.col("o_custkey") * 7 + F.col("o_orderkey") % 7).alias("num"), F.col("o_orderstatus").alias("s"))
    return manifest.delta(f.where("s <> 'O'"), f.where("s <> 'F'"))


def versions(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 50).alias("version")).agg(F.collect_set("o_custkey").alias("nums"))


@query("select c_custkey as num from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 50 in (select n_nationkey from nation where n_regionkey < 3))")
def orphan_files(spark, sf):
    pinned = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("version"))
    return manifest.orphans(table(spark, sf, "customer").select(F.col("c_custkey").alias("num")), versions(spark, sf), pinned)


@query("select o_custkey as num, count(distinct o_orderkey % 50) as refs from orders group by 1")
def reference_counts(spark, sf):
    return manifest.reference_counts(versions(spark, sf))


@query("select event_id, 100 + row_number() over (order by event_id) as num from events where event_type = 'signup'")
def file_numbers(spark, sf):
    return reads.assign_sequence(table(spark, sf, "events").where("event_type = 'signup'").select("event_id"), ["event_id"], 100, name="num")


@query("with f as (select o_orderkey as num, case o_orderkey % 4 when 0 then 'MANIFEST-' || lpad(o_orderkey::varchar, greatest(6, length(o_orderkey::varchar))::integer, '0') when 1 then lpad(o_orderkey::varchar, greatest(6, length(o_orderkey::varchar))::integer, '0') || '.log' when 2 then lpad(o_orderkey::varchar, greatest(6, length(o_orderkey::varchar))::integer, '0') || '.ldb' else 'other' end as name from orders) select name, case num % 4 when 0 then 'manifest' when 1 then 'journal' when 2 then 'table' end as kind, case when num % 4 < 3 then num end as num from f")
def file_names(spark, sf):
    n = F.col("o_orderkey")
    name = F.when(n % 4 == 0, workspace.file_name("manifest", n)).when(n % 4 == 1, workspace.file_name("journal", n)).when(n % 4 == 2, workspace.file_name("table", n)).otherwise("other")
    return table(spark, sf, "orders").select(name.alias("name")).select("name", workspace.file_kind(F.col("name")).alias("f")).select("name", "f.*")


@query("select max(o_orderkey) as number from orders where o_orderstatus <> 'F' and o_orderpriority like '1%'")
def current_pointer(spark, sf):
    """Versions whose number is that of such an order are complete; the current one is the highest."""
    done = table(spark, sf, "orders").where("o_orderstatus <> 'F' and o_orderpriority like '1%'").select(workspace.file_name("manifest", F.col("o_orderkey")).alias("name"))
    top = done.select(workspace.file_kind(F.col("name"))["num"].alias("n")).groupBy(F.pmod("n", F.lit(64))).agg(F.max("n").alias("n")).collect()
    return spark.createDataFrame([(workspace.highest([r["n"] for r in top]),)], "number long")


# ---- keys, filters, codecs


@query("with v as (select user_id, event_id, case when event_type = 'error' then 2 else 1 end as kt from events) select event_id, upper(hex('u' || user_id)) || (select string_agg(substr(printf('%016X', event_id * 256 + kt), 17 - 2 * i, 2), '' order by i) from range(1, 9) t(i)) as packed from v")
def internal_keys(spark, sf):
    e = table(spark, sf, "events").withColumn("kt", kt()).withColumn("key", F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary"))
    return e.select("event_id", F.hex(keys.internal_key(F.col("key"), F.col("event_id"), F.col("kt"))).alias("packed"))


@query("select event_id, 'u' || user_id as ukey, event_id as seq, case when event_type = 'error' then 2 else 1 end as kt from events")
def internal_keys_parsed(spark, sf):
    e = table(spark, sf, "events").withColumn("key", F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary"))
    p = e.select("event_id", keys.internal_parts(keys.internal_key(F.col("key"), F.col("event_id"), kt())).alias("p"))
    return p.select("event_id", F.col("p.ukey").cast("string").alias("ukey"), F.col("p.seq").alias("seq"), F.col("p.kt").cast("int").alias("kt"))


@query("select row_number() over (order by o_orderkey - 500) as n, o_orderkey - 500 as o_orderkey from orders")
def ordered_encoding_all(spark, sf):
    rows = table(spark, sf, "orders").select(keys.ordered_long(F.col("o_orderkey") - 500).alias("enc"))
    return reads.assign_sequence(rows, ["enc"], 0, name="n").select("n", keys.ordered_long_back(F.col("enc")).alias("o_orderkey"))


@query("select c_custkey, list_reduce(list_prepend(cast(2166136261 as ubigint), list_transform(range(1, length(c_name) + 1), lambda i: cast(ascii(substr(c_name, i, 1)) as ubigint))), lambda h, b: xor((h * 16777619) & 4294967295, b))::bigint as hash from customer")
def bloom_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", bloom.fnv1_column(F.col("c_name").cast("binary")).alias("hash"))


FNV = "list_reduce(list_prepend(cast(2166136261 as ubigint), list_transform(range(1, length(c_name) + 1), lambda i: cast(ascii(substr(c_name, i, 1)) as ubigint))), lambda h, b: xor((h * 16777619) & 4294967295, b))"


@query(f"with k as (select distinct c_nationkey as g, c_name, {FNV} as h from customer), n as (select g, greatest(64, (count(*) * 10 + 7) // 8 * 8) as bits from k group by g), p as (select k.g, n.bits, ((h + i * ((h >> 17) | ((h << 15) & 4294967295))) & 4294967295) % n.bits as bit from k join n using (g), range(0, 7) t(i)) select g, cast(bits as bigint) as n_bits, count(distinct bit) as n_set, cast(sum(distinct bit) as bigint) as bit_sum from p group by g, bits")
def bloom_build(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_name").cast("binary").alias("key"))
    words = bloom.build_words(c, "g", "key")
    total = F.aggregate(bloom.set_bits(F.col("word"), F.col("bits")), F.lit(0).cast("long"), lambda a, b: a + b)
    return words.groupBy("g", "n_bits").agg(F.sum(F.bit_count("bits")).alias("n_set"), F.sum(total).alias("bit_sum"))


@query("select c_custkey, true as maybe from customer")
def bloom_probe(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.col("c_name").cast("binary").alias("key"))
    return bloom.may_hold(bloom.build_words(c, "g", "key"), c, "g", "key").select("c_custkey", "maybe")


@query(f"with k as (select distinct c_nationkey as g, c_name, {FNV} as h from customer), n as (select g, greatest(64, (count(*) * 10 + 7) // 8 * 8) as bits from k group by g), p as (select distinct k.g, ((h + i * ((h >> 17) | ((h << 15) & 4294967295))) & 4294967295) % n.bits as bit from k join n using (g), range(0, 7) t(i)), a as (select c_custkey, g, {FNV} as h from (select c_custkey, (c_nationkey + 1) % 25 as g, c_name || '?' as c_name from customer)), b as (select distinct a.c_custkey, a.g, ((h + i * ((h >> 17) | ((h << 15) & 4294967295))) & 4294967295) % n.bits as bit from a join n using (g), range(0, 7) t(i)) select a.c_custkey, count(b.bit) > 0 and count(b.bit) = count(p.bit) as maybe from a left join b on a.c_custkey = b.c_custkey left join p on b.g = p.g and b.bit = p.bit group by a.c_custkey")
def bloom_probe_absent(spark, sf):
    """Names that no filter was given are asked of another nation's filter: true only where all their bits happen to be set."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.col("c_name").cast("binary").alias("key"))
    asked = table(spark, sf, "customer").select("c_custkey", F.pmod(F.col("c_nationkey") + 1, F.lit(25)).alias("g"), F.concat("c_name", F.lit("?")).cast("binary").alias("key"))
    return bloom.may_hold(bloom.build_words(c, "g", "key"), asked, "g", "key").select("c_custkey", "maybe")


@query("select 'u' || user_id as ukey, event_id as seq, case when event_type = 'error' then 2 else 1 end as kt, case when event_type <> 'error' then event_type end as value from events")
def journal_round_trip(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary").alias("ukey"), F.col("event_id").alias("seq"), kt().cast("byte").alias("kt"), F.when(F.col("event_type") != "error", F.col("event_type")).cast("binary").alias("value"))
    back = journal.decode_rows(journal.encode_rows(e))
    return back.select(F.col("ukey").cast("string").alias("ukey"), "seq", F.col("kt").cast("int").alias("kt"), F.col("value").cast("string").alias("value"))


# ---- the store, end to end


def changes(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary").alias("ukey"), kt().cast("byte").alias("kt"), F.when(F.col("event_type") != "error", F.col("value").cast("string")).cast("binary").alias("value"), "event_id")


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ukey").cast("string").alias("ukey"), (F.col("seq") - 1).alias("event_id"), F.col("value").cast("string").cast("double").alias("value"))


LIVE = "select 'u' || user_id as ukey, max(event_id) as event_id, max_by(value, event_id) as value from events group by user_id having max_by(event_type, event_id) <> 'error'"


@query(LIVE)
def store_scan_after_compaction(spark, sf):
    """Four bulk writes, each a table set of level 0, then compaction into level 1, then a scan."""
    store = Store.open(spark, shared_dir(spark, "store"), Options(l0_pause=4))
    rows = changes(spark, sf)
    top = rows.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] + 1
    for i in range(4):
        store.bulk_write(rows.where((F.col("event_id") >= top * i // 4) & (F.col("event_id") < top * (i + 1) // 4)), ["event_id"])
    store.compact()
    return shown(store.scan())


@query("with v as (select * from events where user_id in (3, 5, 8)) select 'u' || user_id as ukey, max(event_id) as event_id, max_by(value, event_id) as value from v group by user_id having max_by(event_type, event_id) <> 'error'")
def store_multi_get(spark, sf):
    store = Store.open(spark, shared_dir(spark, "store"))
    store.bulk_write(changes(spark, sf), ["event_id"])
    asked = spark.range(1).select(F.explode(F.array(F.lit("u3"), F.lit("u5"), F.lit("u8"))).alias("ukey")).select(F.col("ukey").cast("binary").alias("ukey"))
    return shown(store.multi_get(asked, how="inner"))


@query(LIVE)
def stream_ingest(spark, sf):
    """The history as a stream of micro-batches into the store."""
    path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parque[t]")  # a pattern: the table may be one file
    kind = kt().cast("byte").alias("kt")
    rows = stream.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary").alias("ukey"), kind, F.when(F.col("event_type") != "error", F.col("value").cast("string")).cast("binary").alias("value"), "event_id")
    store = Store.open(spark, shared_dir(spark, "store"))
    ingest.ingest(rows, store, ["event_id"], shared_dir(spark, "stream")).awaitTermination()
    return shown(store.scan())


@query(f"with {V}, {NEWEST} select k, seq, val from newest where kt = 1")
def stream_live_view(spark, sf):
    """The newest versions as streaming state; the last micro-batch's view is what is read."""
    path, out = f"{sf}/events.parquet", shared_dir(spark, "live")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parque[t]")
    rows = stream.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), kt().alias("kt"), F.col("value").alias("val"))
    view = ingest.live_view(rows, "k", "seq", "kt", ["val"])
    sink = view.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    sink.option("checkpointLocation", shared_dir(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return ingest.present(spark.read.parquet(out), "kt")


# ---- the store's parts, each through the code that the store runs

NATIONS = "nations as (select n_name as ukey, row_number() over (order by n_nationkey) as seq, n_regionkey as value from nation)"


def nation_rows(spark, sf) -> list:
    """25 rows at any scale: what a program puts one by one."""
    return table(spark, sf, "nation").orderBy("n_nationkey").collect()


def put_nations(spark, sf, **options) -> Store:
    store = Store.open(spark, shared_dir(spark, "store"), Options(**options))
    for r in nation_rows(spark, sf):
        store.put(r["n_name"].encode(), str(r["n_regionkey"]).encode())
    return store


def text_rows(rows: DataFrame, *more) -> DataFrame:
    return rows.select(F.col("ukey").cast("string").alias("ukey"), "seq", F.col("value").cast("string").cast("int").alias("value"), *more)


@query(f"with {NATIONS} select ukey, seq, value from nations where value <> 2")
def store_put_delete(spark, sf):
    store = put_nations(spark, sf)
    for r in nation_rows(spark, sf):
        if r["n_regionkey"] == 2:
            store.delete(r["n_name"].encode())
    return text_rows(store.scan())


@query(f"with {NATIONS} select ukey, seq, value from nations")
def store_recovery(spark, sf):
    """Puts that no table holds come back from the journal when the store is opened again."""
    store = put_nations(spark, sf)
    return text_rows(Store.open(spark, store.root).scan())


@query(f"with {NATIONS} select ukey, seq, value, 1 as kt, 0 as level from nations")
def store_flush(spark, sf):
    """What the table of level 0 holds after a flush; the journal is empty then."""
    store = put_nations(spark, sf)
    store.flush()
    assert not store.buffer and not store.files.names("journal")
    return text_rows(store._read(store.version.level(0)), F.col("kt").cast("int").alias("kt"), F.lit(0).alias("level"))


@query("select 'u' || user_id as ukey, max(event_id) as event_id, max_by(value, event_id) as value from events where event_id < (select (max(event_id) + 1) // 2 from events) group by user_id having max_by(event_type, event_id) <> 'error'")
def store_snapshot(spark, sf):
    """A snapshot held over later writes and a compaction reads what it read at first."""
    store = Store.open(spark, shared_dir(spark, "store"), Options(l0_pause=2))
    rows = changes(spark, sf)
    half = (rows.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] + 1) // 2
    store.bulk_write(rows.where(F.col("event_id") < half), ["event_id"])
    with store.snapshot() as at:
        store.bulk_write(rows.where(F.col("event_id") >= half), ["event_id"])
        store.compact()
        path = shared_dir(spark, "view")
        store.scan(at).write.parquet(path)
    return shown(spark.read.parquet(path))


@query("select count(*) as n, min('u' || user_id) as min_key, max('u' || user_id) as max_key, count(*) as top, 1 as low from events")
def store_table_stats(spark, sf):
    store = Store.open(spark, shared_dir(spark, "store"))
    store.bulk_write(changes(spark, sf), ["event_id"])
    held = store.version.files
    low, high = manifest.hull(held)
    return spark.createDataFrame([(sum(f.rows for f in held), low.decode(), high.decode(), max(f.max_seq for f in held), min(f.min_seq for f in held))], "n long, min_key string, max_key string, top long, low int")


@query("select count(*) as seq, 5 as versions, count(distinct user_id) as n_keys from events")
def store_reopen(spark, sf):
    """Four bulk writes, then the store anew: the highest complete version is the current one."""
    store = Store.open(spark, shared_dir(spark, "store"))
    rows = changes(spark, sf)
    for i in range(4):
        store.bulk_write(rows.where(F.col("event_id") % 4 == i), ["event_id"])
    again = Store.open(spark, store.root)
    n = again.changes().select("ukey").distinct().count()
    return spark.createDataFrame([(again.seq, again.version.number, n)], "seq long, versions int, n_keys long")


@query("select n_name as name, n_nationkey as size from nation where n_regionkey <> 3 union all select n_name || '.moved', n_nationkey from nation where n_regionkey = 3 and n_nationkey % 2 = 0")
def storage_files(spark, sf):
    """Files written, renamed, removed, listed."""
    held = workspace.Files(spark, shared_dir(spark, "files"))
    for r in nation_rows(spark, sf):
        held.write(f"d/{r['n_name']}", b"x" * r["n_nationkey"])
    for r in nation_rows(spark, sf):
        if r["n_regionkey"] == 3:
            held.rename(f"d/{r['n_name']}", f"d/{r['n_name']}.moved") if r["n_nationkey"] % 2 == 0 else held.delete(f"d/{r['n_name']}")
    return spark.createDataFrame([(n, held.size(f"d/{n}")) for n in held.names("d")], "name string, size int")


@query("select * from (values ('a', 'x'), ('b', 'y'), ('conflict', 'Conflict')) t(ukey, value)")
def single_writer(spark, sf):
    """Two writers: the second one's put is refused until it has seen the first one's."""
    a = Store.open(spark, shared_dir(spark, "store"))
    b = Store.open(spark, a.root)
    a.put(b"a", b"x")
    try:
        b.put(b"b", b"y")
        refused = "none"
    except errors.Conflict as e:
        refused = type(e).__name__
    b.refresh()
    b.put(b"b", b"y")
    b.put(b"conflict", refused.encode())
    return b.scan().select(F.col("ukey").cast("string").alias("ukey"), F.col("value").cast("string").alias("value"))


@query("select * from (values ('pinned', 0), ('let go', 1)) t(state, removed)")
def version_pins(spark, sf):
    """Tables that only a pinned version has stay until the pin is gone."""
    store = Store.open(spark, shared_dir(spark, "store"), Options(l0_pause=2))
    rows = changes(spark, sf)
    store.bulk_write(rows.where("event_id < 100"), ["event_id"])
    with store.pinned():
        store.bulk_write(rows.where("event_id < 100"), ["event_id"])
        held = {f.path for f in store.version.files}
        store.compact()
        store.bulk_write(rows.where("event_id < 100"), ["event_id"])
        before = store.vacuum(0) - (len(held) - 1)
    after = store.vacuum(0)
    return spark.createDataFrame([("pinned", before), ("let go", after)], "state string, removed int")


@query("select * from (values ('closed', 'Closed'), ('read only', 'ReadOnly'), ('absent', 'NotFound'), ('bad table', 'Corrupted'), ('bad key', 'Corrupted'), ('old batch', 'BatchHeaderError'), ('taken version', 'Conflict')) t(what, kind)")
def error_kinds(spark, sf):
    root = shared_dir(spark, "store")
    store, other = Store.open(spark, root), Store.open(spark, root)
    store._commit(manifest.Edit())
    done = Store.open(spark, root)
    done.close()
    tries = {
        "closed": lambda: done.get(b"a"), "read only": lambda: Store.open(spark, root, Options(read_only=True)).put(b"a", b"b"), "absent": lambda: store.get(b"no"), "bad table": lambda: tablefile.Table(b"no table"),
        "bad key": lambda: keys.unpack(b"short"), "old batch": lambda: list(journal.decode_batch(journal.encode_batch(3, []), 4)), "taken version": lambda: other._commit(manifest.Edit()),
    }
    out = []
    for what, f in tries.items():
        try:
            f()
            out.append((what, "none"))
        except errors.StoreError as e:
            out.append((what, type(e).__name__))
    return spark.createDataFrame(out, "what string, kind string")


@query("select * from (values ('block_size', 2048), ('bloom_bits', 10), ('compaction_files', 25), ('l0_pause', 12), ('l0_slowdown', 8), ('level_base', 10485760), ('level_factor', 10), ('restart_interval', 16), ('trivial_grandparents', 10), ('write_buffer', 4194304), ('level_budget(2)', 1048576000), ('l0_trigger', 12)) t(name, value)")
def option_values(spark, sf):
    o = Options()
    names = ["block_size", "bloom_bits", "compaction_files", "l0_pause", "l0_slowdown", "level_base", "level_factor", "restart_interval", "trivial_grandparents", "write_buffer"]
    return spark.createDataFrame([*((n, getattr(o, n)) for n in names), ("level_budget(2)", o.level_budget(2)), ("l0_trigger", o.l0_trigger)], "name string, value int")


@query("with c as (select o_custkey as k, count(*) as n from orders group by 1), r as (select * from (values (true), (false)) t(room)) select k, room, case when n >= 12 and not room then 'pause' when n >= 8 and n < 12 then 'slow' when room then 'go' else 'rotate' end as state from c, r")
def back_pressure_states(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("room", F.explode(F.array(F.lit(True), F.lit(False))))

    def states(parts):
        for p in parts:
            p["state"] = [manifest.back_pressure(int(a), bool(b)) for a, b in zip(p["n"], p["room"], strict=True)]
            yield p[["k", "room", "state"]]

    return n.mapInPandas(states, "k long, room boolean, state string")


# three levels of disjoint files over the order keys; the second has gaps
LEVELS = "l as (select 1 as level, o_orderkey // 1000 as num, count(*) as size, min(o_orderkey) as lo, max(o_orderkey) as hi from orders group by 2 union all select 2, 100000 + o_orderkey // 300, count(*), min(o_orderkey), max(o_orderkey) from orders where (o_orderkey // 300) % 5 < 2 group by 2 union all select 3, 200000 + o_orderkey // 100, count(*), min(o_orderkey), max(o_orderkey) from orders group by 2)"
PLAN = f"""with {LEVELS}, p as (select r_regionkey as r, r_regionkey * 397 as pointer from region),
seed as (select p.r, arg_min(l.num, l.lo) as num, min(l.lo) as lo, arg_min(l.hi, l.lo) as hi from p join l on l.level = 1 and l.hi > p.pointer group by p.r union all select p.r, (select arg_min(num, lo) from l where level = 1), (select min(lo) from l where level = 1), (select arg_min(hi, lo) from l where level = 1) from p where not exists (select 1 from l where level = 1 and hi > p.pointer)),
below as (select s.r, l.* from seed s join l on l.level = 2 and l.lo <= s.hi and l.hi >= s.lo),
hull1 as (select s.r, least(s.lo, coalesce(min(b.lo), s.lo)) as lo, greatest(s.hi, coalesce(max(b.hi), s.hi)) as hi from seed s left join below b on s.r = b.r group by s.r, s.lo, s.hi),
grown as (select h.r, l.* from hull1 h join l on l.level = 1 and l.lo <= h.hi and l.hi >= h.lo),
hull2 as (select r, min(lo) as lo, max(hi) as hi from grown group by r),
below2 as (select h.r, l.num from hull2 h join l on l.level = 2 and l.lo <= h.hi and l.hi >= h.lo),
take as (select h.r, (select count(*) from below2 b where b.r = h.r) = (select count(*) from below b where b.r = h.r) as yes from hull2 h),
inputs as (select g.r, g.num, g.lo, g.hi from grown g join take t on g.r = t.r and t.yes union all select s.r, s.num, s.lo, s.hi from seed s join take t on s.r = t.r and not t.yes),
both_ as (select r, lo, hi from inputs union all select r, lo, hi from below), hull3 as (select r, min(lo) as lo, max(hi) as hi from both_ group by r),
grand as (select h.r, l.num from hull3 h join l on l.level = 3 and l.lo <= h.hi and l.hi >= h.lo),
roles as (select r, 'input' as role, num from inputs union all select r, 'below', num from below union all select r, 'grandparent', num from grand)"""


def plans(spark, sf) -> list:
    """(r, plan) for a compaction pointer of each region."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    kinds = [(1, 0, 1000, F.lit(True)), (2, 100000, 300, F.floor(F.col("k") / 300) % 5 < 2), (3, 200000, 100, F.lit(True))]
    levels = [o.where(w).groupBy((first + F.floor(F.col("k") / width)).alias("num")).agg(F.count(F.lit(1)).alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi")).withColumn("level", F.lit(level)) for level, first, width, w in kinds]
    held = [manifest.File(r["level"], r["num"], r["size"], r["lo"], r["hi"]) for x in levels for r in x.collect()]  # a row a file
    regions = [r["r_regionkey"] for r in table(spark, sf, "region").collect()]
    only_first = lambda version, options: [0.0, 2.0, 0.0, 0.0]
    return [(r, manifest.pick(manifest.Version(held, pointers={1: r * 397}), Options(), only_first)) for r in regions]


@query(f"{PLAN} select r, role, num from roles")
def compaction_plan(spark, sf):
    """Which files a compaction of level 1 takes from each pointer on: inputs, those below, grandparents."""
    out = [(r, role, f.num) for r, plan in plans(spark, sf) for role, fs in (("input", plan.inputs), ("below", plan.below), ("grandparent", plan.grandparents)) for f in fs]
    return spark.createDataFrame(out, "r int, role string, num long")


@query(f"{PLAN}, n as (select r, count(*) filter (role = 'input') as i, count(*) filter (role = 'below') as b, count(*) filter (role = 'grandparent') as g from roles group by r) select r, i = 1 and b = 0 and g < 10 as trivial, case when i = 1 and b = 0 and g < 10 then 2 end as level from n")
def trivial_move(spark, sf):
    out = []
    for r, plan in plans(spark, sf):
        trivial = plan.trivial(Options())
        out.append((r, trivial, plan.moved().add[0].level if trivial else None))
    return spark.createDataFrame(out, "r int, trivial boolean, level int")


@query(f"with {FILES} select num, cast(level as integer) as level, row_number() over (partition by level order by case when level = 0 then num else min_key end, num) as place from files")
def sorted_files(spark, sf):
    held = [manifest.File(r["level"], r["num"], r["size"], r["min_key"], r["max_key"]) for r in files(spark, sf).collect()]  # a row a file
    version = manifest.Version(held)
    return spark.createDataFrame([(f.num, n, i) for n in range(version.depth) for i, f in enumerate(version.level(n), 1)], "num long, level int, place long")


def edit_of(r) -> manifest.Edit:
    key = str(r["num"]).encode()
    if r["action"] == "del":
        return manifest.Edit(delete=[(r["level"], r["num"])], seq=r["ord"])
    return manifest.Edit(add=[manifest.File(r["level"], r["num"], r["size"], key, key + b"z")], seq=r["ord"])


@query(f"with {EDITS} select ord, action, level, num, case when action = 'add' then size end as size from edits")
def edit_codec(spark, sf):
    """Each edit in bytes and back, on the executors."""

    def there_and_back(parts):
        import pandas as pd

        for p in parts:
            out = []
            for r in p.to_dict("records"):
                e = editlog.decode(editlog.encode(edit_of(r)))
                out += [(e.seq, "add", f.level, f.num, f.size) for f in e.add] + [(e.seq, "del", level, num, None) for level, num in e.delete]
            yield pd.DataFrame(out, columns=["ord", "action", "level", "num", "size"]).astype({"size": "Int64"})

    return edits(spark, sf).select("ord", "action", "level", "num", "size").mapInPandas(there_and_back, "ord long, action string, level int, num long, size long")


@query(f"with {EDITS}, l as (select *, row_number() over (partition by level, num order by ord desc) as n from edits) select level, num, size from l where n = 1 and action = 'add'")
def manifest_rewrite(spark, sf):
    """A log of edits read into a version, the version written as one edit, that read again.

    The log stays on the executors, in segments. The version has a file a (level, num), at most 600 here whatever the log's length.
    """
    first = spark.createDataFrame([(-1, bytearray(editlog.write_log([manifest.Edit(comparer="bytewise", next_file=1, journal=0, seq=0)])))], editlog.SEGMENTS)
    log = first.unionByName(editlog.segments(edits(spark, sf).select("ord", "action", "level", "num", "size"), edit_of, ["ord"]))
    again = editlog.recover(editlog.write_log([editlog.snapshot(editlog.recover_segments(log))]))
    return spark.createDataFrame([(f.level, f.num, f.size) for f in again.files], "level int, num long, size long")


STEPS = "(1, 0, '0,1,2,3'), (1, 1, '4'), (2, 0, '0,1,2,3'), (2, 1, '4,6'), (3, 0, '0,1,2,3'), (3, 1, '4'), (4, 0, '0,1,2,3'), (4, 1, '')"


@query(f"select * from (values {STEPS}) t(step, level, nums)")
def version_steps(spark, sf):
    """Four edits after each other; a file that one edit adds and deletes is never there."""
    new = lambda level, num, a, b: manifest.File(level, num, 100, a * 6, b * 6)
    steps = [
        manifest.Edit(add=[new(0, 0, "a", "b"), new(0, 1, "c", "d"), new(0, 2, "e", "f"), new(0, 3, "a", "f"), new(1, 4, "i", "j")]), manifest.Edit(add=[new(1, 5, "k", "l"), new(1, 6, "m", "n")], delete=[(1, 5)]),
        manifest.Edit(delete=[(1, 6)]), manifest.Edit(delete=[(1, 4)]),
    ]
    out, version = [], manifest.Version()
    for i, e in enumerate(steps, 1):
        version = version.apply(e)
        out += [(i, n, ",".join(str(f.num) for f in version.level(n))) for n in (0, 1)]
    return spark.createDataFrame(out, "step int, level int, nums string")


NEXT_KEYS = "w as (select c_custkey, c_name as a, c_name || '/' || c_nationkey as low, lead(c_name) over (order by c_name) || c_mktsegment as b from customer)"


@query(f"with {NEXT_KEYS}, n as (select c_custkey, low, b, list_filter(range(1, length(low) + 1), lambda i: substr(low, i, 1) <> substr(b, i, 1))[1] as d from w where b is not null), x as (select c_custkey, low, list_filter(list_transform(range(d, length(low)), lambda i: substr(low, 1, i - 1) || chr(ascii(substr(low, i, 1)) + 1)), lambda t: t < b)[1] as sep from n) select c_custkey, coalesce(sep, low) as sep, 'D' as succ from x")
def separators(spark, sf):
    """A short key from each name to the next one on, and a short key at or above the name."""
    c = table(spark, sf, "customer")
    low = F.concat("c_name", F.lit("/"), F.col("c_nationkey").cast("string"))
    part = reads.assign_sequence(c.select("c_custkey", "c_name", "c_mktsegment", low.alias("low")), ["c_name"], 0, name="n")
    after = part.select((F.col("n") - 1).alias("n"), F.concat("c_name", "c_mktsegment").alias("b"))

    def short(parts):
        for p in parts:
            p["sep"] = [keys.separator(a.encode(), b.encode()).decode() for a, b in zip(p["low"], p["b"], strict=True)]
            p["succ"] = [keys.successor(a.encode()).decode() for a in p["low"]]
            yield p[["c_custkey", "sep", "succ"]]

    return part.select("n", "c_custkey", "low").join(after, "n").select("c_custkey", "low", "b").mapInPandas(short, "c_custkey long, sep string, succ string")


def block_tables(spark, sf) -> DataFrame:
    """(g, data): a block table of each nation's customers, keys in internal form, built on the executors."""
    import pandas as pd

    def build(p):
        rows = sorted((keys.pack(n.encode(), int(k), 1), m.encode()) for n, k, m in zip(p["c_name"], p["c_custkey"], p["c_mktsegment"], strict=True))
        return pd.DataFrame({"g": [int(p["c_nationkey"].iloc[0])], "data": [tablefile.build_table(rows, user_key=user_part)]})

    return table(spark, sf, "customer").groupBy("c_nationkey").applyInPandas(build, "g int, data binary")


def user_part(key: bytes) -> bytes:
    return key[:-8]


@query("select c_name as ukey, c_custkey as seq, c_mktsegment as value from customer")
def table_round_trip(spark, sf):
    """Blocks, index, filter and footer written and scanned; every block's checksum is looked at."""

    def scan(parts):
        import pandas as pd

        for p in parts:
            rows = [(*keys.unpack(k), v) for data in p["data"] for k, v in tablefile.Table(bytes(data)).scan()]
            yield pd.DataFrame([(u.decode(), s, v.decode()) for u, s, _, v in rows], columns=["ukey", "seq", "value"])

    return block_tables(spark, sf).mapInPandas(scan, "ukey string, seq long, value string")


@query("select c_custkey, c_mktsegment as value, cast(null as varchar) as absent, c_name as next from customer")
def table_lookup(spark, sf):
    """Point reads of the block tables: the filter has user keys, an absent key has no value, a seek finds the next key."""
    import pandas as pd

    asked = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("g"))

    def look(_, wanted, tables):
        if not len(tables):
            return pd.DataFrame(columns=["c_custkey", "value", "absent", "next"])
        t = tablefile.Table(bytes(tables["data"].iloc[0]), user_key=user_part)
        out = []
        for k, n in zip(wanted["c_custkey"], wanted["c_name"], strict=True):
            here, no = t.get(keys.pack(n.encode(), int(k), 1)), t.get(keys.pack(n.encode() + b"?", int(k), 1))
            out.append((k, here and here.decode(), no and no.decode(), keys.unpack(t.find(n.encode())[0])[0].decode()))
        return pd.DataFrame(out, columns=["c_custkey", "value", "absent", "next"])

    return asked.groupBy("g").cogroup(block_tables(spark, sf).groupBy("g")).applyInPandas(look, "c_custkey long, value string, absent string, next string")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

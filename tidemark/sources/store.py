"""The store: a change log as sorted Parquet tables in levels, a log of version edits, and a journal.

    root/_log/<version>.json         one edit a version; creating the file is the commit
    root/_log/<version>.state.json   the whole version, every CHECKPOINT commits
    root/data/...                    tables: key, newest version first
    root/journal/<number>.log        batches that no table holds yet
    root/_pins/<id>.json             versions and sequence numbers that readers hold
    root/_running/<folder>           folders of data whose commit is not done

The driver holds the manifest (a row a file) and the write buffer (bounded by Options.write_buffer). Rows are read, merged
and written by Spark. A writer that loses the race for the number of a version or of a journal file gets Conflict and has changed
nothing; after refresh() it can go on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import Closed, Conflict, Corrupted, NotFound, ReadOnly
from tidemark.operators.compaction import compacted, min_live_snapshot
from tidemark.operators.reads import ChangeLog, numbered_rows
from tidemark.options import DELETE, PUT, Options
from tidemark.plans.manifest import Compaction, Edit, File, Version, back_pressure, grandparent_cuts, hull, pick
from tidemark.sources import journal
from tidemark.workspace import Files, highest

SCHEMA = "ukey binary, seq long, kt byte, value binary"
CHECKPOINT = 50


def file_json(f: File) -> dict:
    return {**f.__dict__, "min_key": f.min_key.hex(), "max_key": f.max_key.hex()}


def file_of(d: dict) -> File:
    return File(**{**d, "min_key": bytes.fromhex(d["min_key"]), "max_key": bytes.fromhex(d["max_key"])})


class Store:
    """Open with Store.open; use as a context manager to close."""

    def __init__(self, spark: SparkSession, root: str, options: Options):
        self.spark, self.root, self.options = spark, root, options
        self.files = Files(spark, root)
        self.buffer: list[tuple[bytes, int, int, bytes | None]] = []
        self.buffered = 0
        self.pins: dict[str, dict] = {}
        self.snapshots: list[int] = []
        self.replayed: set[str] = set()
        self.applied: dict[str, int] = {}
        self.closed = False
        self.version = self._load()
        self.seq = self.version.seq
        self.next_journal = self._free_journal()

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: Options | None = None) -> Store:
        """The store at root, created if there is none; batches of the journal that no table holds are read again."""
        store = cls(spark, root, options or Options())
        if store.version.number == 0 and not store.options.read_only:
            store._commit(Edit(comparer="bytewise", next_file=1, journal=0, seq=0))
        store._recover()
        return store

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.closed = True

    def _open(self, write: bool = False) -> None:
        if self.closed:
            raise Closed("the store is closed")
        if write and self.options.read_only:
            raise ReadOnly("the store was opened for reading")

    def _free_journal(self) -> int:
        return max([self.version.journal, *(int(n.split(".")[0]) + 1 for n in self.files.names("journal") if n.endswith(".log"))])

    # ---- manifest

    def _load(self, upto: int | None = None) -> Version:
        """The last whole state and the edits after it. Each scalar must have been set by some edit."""
        names = self.files.names("_log")
        states = [int(n[:20]) for n in names if n.endswith(".state.json") and (upto is None or int(n[:20]) <= upto)]
        version = Version(comparer="")
        if states:
            d = json.loads(self.files.read(f"_log/{highest(states):020d}.state.json"))
            version = Version([file_of(f) for f in d["files"]], d["number"], d["seq"], d["next_file"], d["journal"], d["comparer"], {int(k): bytes.fromhex(v) for k, v in d["pointers"].items()})
            self.applied |= d["applied"]
        for n in sorted(int(n[:20]) for n in names if n.endswith(".json") and not n.endswith(".state.json")):
            if n <= version.number or upto is not None and n > upto:
                continue
            if n != version.number + 1:
                raise Corrupted(f"edit {version.number + 1} is missing", self.root)
            d = json.loads(self.files.read(f"_log/{n:020d}.json"))
            version = version.apply(Edit([file_of(f) for f in d["add"]], [tuple(x) for x in d["delete"]], d["seq"], d["next_file"], d["journal"], d["comparer"], {int(k): bytes.fromhex(v) for k, v in d["pointers"].items()}))
            self.applied |= d["applied"]
        if version.number and not version.comparer:
            raise Corrupted("no edit names the comparer", self.root)
        version.check()
        return version

    def _commit(self, edit: Edit, applied: dict[str, int] | None = None) -> None:
        version = self.version.apply(edit)
        version.check()
        d = {"add": [file_json(f) for f in edit.net().add], "delete": edit.net().delete, "seq": edit.seq, "next_file": edit.next_file, "journal": edit.journal, "comparer": edit.comparer, "pointers": {k: v.hex() for k, v in edit.pointers.items()}, "applied": applied or {}}
        try:
            self.files.write(f"_log/{version.number:020d}.json", json.dumps(d).encode())
        except FileExistsError:
            raise Conflict(f"version {version.number} is taken") from None
        self.version = version
        self.applied |= applied or {}
        if version.number % CHECKPOINT == 0:
            state = {"files": [file_json(f) for f in version.files], "number": version.number, "seq": version.seq, "next_file": version.next_file, "journal": version.journal, "comparer": version.comparer, "pointers": {k: v.hex() for k, v in version.pointers.items()}, "applied": self.applied}
            self.files.write(f"_log/{version.number:020d}.state.json", json.dumps(state).encode())

    def refresh(self) -> None:
        """See what other writers have committed, and what they have put in the journal."""
        self.version = self._load()
        self.seq = max(self.seq, self.version.seq)
        self.buffer = [r for r in self.buffer if r[1] > self.version.seq]
        self.buffered = sum(len(k) + len(v or b"") + 16 for k, _, _, v in self.buffer)
        self._recover()
        self.next_journal = self._free_journal()

    # ---- writes

    def put(self, key: bytes, value: bytes) -> int:
        return self.write([(PUT, key, value)])

    def delete(self, key: bytes) -> int:
        return self.write([(DELETE, key, None)])

    def write(self, entries: list[tuple[int, bytes, bytes | None]]) -> int:
        """A batch, all or nothing: its entries get the next sequence numbers in order. Returns the last one."""
        self._open(write=True)
        if not entries:
            return self.seq
        base = self.seq + 1
        self._journal(base, entries)
        self._remember([(key, base + i, kind, value) for i, (kind, key, value) in enumerate(entries)])
        self.seq = base + len(entries) - 1
        if back_pressure(len(self.version.level(0)), self.buffered < self.options.write_buffer, self.options) == "pause":
            self.compact()
        if self.buffered >= self.options.write_buffer:
            self.flush()
        return self.seq

    def _journal(self, base: int, entries: list[tuple[int, bytes, bytes | None]]) -> None:
        """A batch as the next journal file. Without entries it only says that the sequence numbers before base are taken."""
        out = journal.Writer()
        out.chunk(journal.encode_batch(base, entries))
        name = f"{self.next_journal:06d}.log"
        try:
            self.files.write(f"journal/{name}", bytes(out.data))
        except FileExistsError:
            raise Conflict(f"journal file {name} is taken") from None
        self.replayed.add(name)
        self.next_journal += 1

    def _remember(self, rows: list[tuple[bytes, int, int, bytes | None]]) -> None:
        self.buffer += rows
        self.buffered += sum(len(k) + len(v or b"") + 16 for k, _, _, v in rows)

    def _recover(self) -> None:
        names = [n for n in self.files.names("journal") if n.endswith(".log") and n not in self.replayed and int(n.split(".")[0]) >= self.version.journal]
        due = self.version.seq + 1
        # files are read in order and the buffer flushed in between; a batch never spans files
        for n in names:
            for chunk in journal.chunks(self.files.read(f"journal/{n}")):
                self.seq = max(self.seq, journal.BATCH.unpack_from(chunk)[0] - 1)
                for seq, kind, key, value in journal.decode_batch(chunk):
                    if seq >= due:
                        self._remember([(key, seq, kind, value)])
                        self.seq = max(self.seq, seq)
            self.replayed.add(n)
            if self.buffered >= self.options.write_buffer and not self.options.read_only:
                self.flush(upto=int(n.split(".")[0]) + 1)

    def flush(self, upto: int | None = None) -> None:
        """The buffer becomes a table of level 0; the journal files it came from go."""
        self._open(write=True)
        if not self.buffer:
            return
        rows = self.spark.createDataFrame([(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in self.buffer], SCHEMA)
        last = self.next_journal if upto is None else upto
        with self._tables(rows.coalesce(1), 0) as files:
            self._commit(Edit(add=files, seq=self.seq, next_file=self.version.next_file + len(files), journal=last))
        self.buffer, self.buffered = [], 0
        for n in self.files.names("journal"):
            if n.endswith(".log") and int(n.split(".")[0]) < last:
                self.files.delete(f"journal/{n}")

    def bulk_write(self, changes: DataFrame, order: list[str], applied: dict[str, int] | None = None) -> int:
        """changes(ukey, kt, value, and the columns of order): sequence numbers follow the order; one commit.

        The numbers are taken in the journal before the tables are written, so no other writer gets them.
        """
        self._open(write=True)
        self.flush()
        if applied and any(self.applied.get(k, -1) >= v for k, v in applied.items()):
            return self.seq
        numbered, n = numbered_rows(changes, order, self.seq)
        last = self.seq + n
        numbered = numbered.select("ukey", "seq", F.col("kt").cast("byte").alias("kt"), "value")
        self._journal(last + 1, [])
        with self._tables(numbered, 0) as files:
            self._commit(Edit(add=files, seq=last, next_file=self.version.next_file + len(files), journal=self.next_journal), applied)
        self.seq = last
        return self.seq

    @contextmanager
    def _tables(self, rows: DataFrame, level: int, zone: Column | None = None) -> Iterator[list[File]]:
        """Write rows, each partition sorted into one table (one a zone, if given), and describe the tables to the block that
        commits them. Until the block ends the folder is marked as running, so that no vacuum takes it."""
        folder = f"data/{uuid.uuid4().hex}"
        mark = f"_running/{folder[5:]}"
        self.files.write(mark, b"")
        columns = ["ukey", "seq", "kt", "value"]
        if zone is None:
            rows.select(*columns).sortWithinPartitions("ukey", F.desc("seq")).write.parquet(f"{self.root}/{folder}")
            read = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{folder}").withColumn("zone", F.lit(""))
        else:
            out = rows.select(*columns, zone.alias("zone")).sortWithinPartitions("zone", "ukey", F.desc("seq"))
            out.write.partitionBy("zone").parquet(f"{self.root}/{folder}")
            read = self.spark.read.schema(f"{SCHEMA}, zone int").parquet(f"{self.root}/{folder}").withColumn("zone", F.format_string("zone=%d/", "zone"))
        # a row a file reaches the driver
        stats = read.groupBy("_metadata.file_name", "_metadata.file_size", "zone").agg(F.min("ukey").alias("a"), F.max("ukey").alias("b"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("s"), F.max("seq").alias("t"))
        first = self.version.next_file
        yield [File(level, first + i, r["file_size"], bytes(r["a"]), bytes(r["b"]), r["n"], r["s"], r["t"], f"{folder}/{r['zone']}{r['file_name']}") for i, r in enumerate(sorted(stats.collect(), key=lambda r: (bytes(r["a"]), r["file_name"])))]
        self.files.delete(mark)

    # ---- reads

    @contextmanager
    def _pin(self, held: dict) -> Iterator[None]:
        """Tell other processes too what is held until the block ends."""
        name = f"_pins/{uuid.uuid4().hex}.json"
        self.files.write(name, json.dumps(held).encode())
        self.pins[name] = held
        try:
            yield
        finally:
            del self.pins[name]
            self.files.delete(name)

    def held(self) -> list[dict]:
        """What readers hold, of any process: {"version": n} or {"seq": n}. Pins older than pin_hours of others are left over."""
        out = list(self.pins.values())
        for n in self.files.names("_pins"):
            if f"_pins/{n}" not in self.pins and self.files.age(f"_pins/{n}") < self.options.pin_hours * 3600:
                try:
                    out.append(json.loads(self.files.read(f"_pins/{n}")))
                except Exception:  # it has just been let go
                    if n in self.files.names("_pins"):
                        raise
        return out

    @contextmanager
    def snapshot(self) -> Iterator[int]:
        """A sequence number whose view stays as it is until the block ends."""
        self._open()
        at = self.seq
        self.snapshots.append(at)
        try:
            with self._pin({"seq": at}):
                yield at
        finally:
            self.snapshots.remove(at)

    @contextmanager
    def pinned(self) -> Iterator[Version]:
        """The current version; its files are not removed until the block ends."""
        self._open()
        v = self.version
        with self._pin({"version": v.number, "files": [f.path for f in v.files]}):
            yield v

    def changes(self, low: bytes | None = None, high: bytes | None = None, version: Version | None = None) -> DataFrame:
        """All versions of keys in [low, high), from the tables whose range meets it and from the buffer."""
        self._open()
        chosen = [f for f in (version or self.version).files if (low is None or f.max_key >= low) and (high is None or f.min_key < high)]
        rows = self._read(chosen)
        held = [(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in self.buffer if (low is None or k >= low) and (high is None or k < high)]
        if held:
            rows = rows.unionByName(self.spark.createDataFrame(held, SCHEMA))
        if low is not None:
            rows = rows.where(F.col("ukey") >= F.lit(bytearray(low)))
        return rows if high is None else rows.where(F.col("ukey") < F.lit(bytearray(high)))

    def _read(self, files: list[File]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/{f.path}" for f in files])

    def scan(self, snapshot: int | None = None, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Live (ukey, seq, value) in [low, high) at the snapshot."""
        return ChangeLog(self.changes(low, high)).live(self.seq if snapshot is None else snapshot)

    def get(self, key: bytes, snapshot: int | None = None) -> bytes:
        """The value, or NotFound. The buffer is newer than any table; of the tables only those whose range has the key are read."""
        self._open()
        at = self.seq if snapshot is None else snapshot
        for k, s, kind, value in reversed(self.buffer):
            if k == key and s <= at:
                if kind == DELETE:
                    raise NotFound(key)
                return value
        chosen = [f for f in self.version.files if f.meets(key, key) and f.min_seq <= at]
        found = ChangeLog(self._read(chosen)).get(bytearray(key), snapshot=at).first() if chosen else None
        if found is None:
            raise NotFound(key)
        return bytes(found["value"])

    def multi_get(self, keys: DataFrame, snapshot: int | None = None, how: str = "left") -> DataFrame:
        return ChangeLog(self.changes()).multi_get(keys, self.seq if snapshot is None else snapshot, how)

    # ---- compaction

    def compact(self, limit: int | None = None) -> int:
        """Run compactions while one is due (limit of them, if given); returns how many."""
        self._open(write=True)
        done = 0
        while (limit is None or done < limit) and (plan := pick(self.version, self.options)):
            self._run(plan)
            done += 1
        return done

    def _run(self, plan: Compaction) -> None:
        if plan.trivial(self.options):
            self._commit(plan.moved())
            return
        inputs = [*plan.inputs, *plan.below]
        keep = min_live_snapshot([*self.snapshots, *(h["seq"] for h in self.held() if "seq" in h)], self.seq)
        low, high = hull(inputs)
        deeper = [(bytearray(f.min_key), bytearray(f.max_key)) for f in self.version.files if f.level > plan.level + 1 and f.meets(low, high)]
        ranges = self.spark.createDataFrame(deeper, "min_key binary, max_key binary") if deeper else None
        parts = max(1, -(-sum(f.size for f in inputs) // self.options.table_size))
        # what stays goes to range partitions by key alone, so a key is never in two tables; zones end where an output would
        # meet too much two levels below
        cuts = [F.lit(bytearray(c)) for c in grandparent_cuts(plan.grandparents, self.options.grandparent_limit)]
        zone = F.size(F.filter(F.array(*cuts), lambda c: c < F.col("ukey"))) if cuts else None
        rows = compacted(self._read(inputs), keep, ranges).repartitionByRange(parts, "ukey")
        with self._tables(rows, plan.level + 1, zone) as files:
            self._commit(Edit(add=files, delete=[(f.level, f.num) for f in inputs], next_file=self.version.next_file + len(files), pointers={plan.level: max(f.max_key for f in plan.inputs)}))

    def vacuum(self, keep_hours: float | None = None) -> int:
        """Remove table files that neither the newest version nor one that a reader of any process holds has.

        Folders whose commit is running and files younger than keep_hours (Options.keep_hours, if left out) stay.
        """
        self._open(write=True)
        least = 3600 * (self.options.keep_hours if keep_hours is None else keep_hours)
        # what is written after this look at the folders is not touched
        folders = self.files.names("data")
        running = {n for n in self.files.names("_running") if self.files.age(f"_running/{n}") < self.options.pin_hours * 3600}
        held = {p for h in self.held() for p in h.get("files", ())} | {f.path for v in (self.version, self._load()) for f in v.files}
        removed = 0
        for folder in folders:
            if folder in running:
                continue
            within = self.files.names(f"data/{folder}")
            for zone in [n for n in within if n.startswith("zone=")]:
                within += [f"{zone}/{n}" for n in self.files.names(f"data/{folder}/{zone}")]
            for name in within:
                path = f"data/{folder}/{name}"
                if name.endswith(".parquet") and path not in held and self.files.age(path) >= least:
                    self.files.delete(path)
                    removed += 1
        return removed

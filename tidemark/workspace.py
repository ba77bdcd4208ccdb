"""Shared folders and files through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The names of a directory's files.
NAMES = {"manifest": r"^MANIFEST-(\d+)$", "journal": r"^(\d+)\.log$", "table": r"^(\d+)\.ldb$", "pending": r"^(\d+)\.temp$"}


def file_name(kind: str, number: Column) -> Column:
    """The name of the file of a kind and number; numbers have six digits at least."""
    text = number.cast("string")
    digits = F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))
    return F.concat(F.lit("MANIFEST-"), digits) if kind == "manifest" else F.concat(digits, F.lit({"journal": ".log", "table": ".ldb", "pending": ".temp"}[kind]))


def file_kind(name: Column) -> Column:
    """struct(kind, num) of a file name; nulls for other names."""
    kind, num = F.lit(None).cast("string"), F.lit(None).cast("long")
    for k, pattern in NAMES.items():
        is_kind = name.rlike(pattern)
        kind = F.when(is_kind, k).otherwise(kind)
        num = F.when(is_kind, F.regexp_extract(name, pattern, 1).cast("long")).otherwise(num)
    return F.struct(kind.alias("kind"), num.alias("num"))


def highest(numbers: list[int]) -> int:
    """The current one of several versions that are complete: the highest number; 0 without any."""
    return max(numbers, default=0)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; a folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """The few file operations that commits need. Driver only; data goes through Spark's readers and writers."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.jvm, self.conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """A whole new file: written beside, then renamed; FileExistsError if the name is taken."""
        part = self.path(f"_tmp/{uuid.uuid4().hex}")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        final = self.path(name)
        self.fs.mkdirs(final.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(part), self.fs.makeQualified(final), none)
        except Exception as e:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(name) from None
            raise

    def rename(self, name: str, to: str) -> None:
        """FileExistsError if the new name is taken."""
        if self.fs.exists(self.path(to)) or not self.fs.rename(self.path(name), self.path(to)):
            raise FileExistsError(to)

    def age(self, name: str) -> float:
        """Seconds since the file was last written."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self.path(name)).getLen()

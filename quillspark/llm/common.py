"""Shared pieces: scratch tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as all contracts here see it: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the record batches that go to Python workers and Spark's own default, which is 64 MB.
BATCH_CONF, BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, as in
    tests in one process, a new local folder is set; with executors elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def sweep(spark: SparkSession, hours: float) -> int:
    """Deletes the operators' tables that were last written more than `hours` ago; gives their
    number. Results are lazy and read such tables, so it is for results that are stored."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quill")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.listStatus(top) if x.getModificationTime() < (time.time() - 3600 * hours) * 1000] if fs.exists(top) else []
    for path in old:
        fs.delete(path, True)
    return len(old)


def small_batches(spark: SparkSession) -> None:
    """Record batches of at most BATCH bytes, or one row, for the session, unless it has set its own
    bound: both the executor's JVM and the worker hold batches several times over."""
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_kept: dict = {}


def kept(key, make):
    """make()'s result, kept in this Python worker for its next tasks; only the latest key's."""
    if key not in _kept:
        give_back()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Frees what earlier operators' tasks have kept in this worker."""
    if _kept:
        give_back()


def give_back() -> None:
    """Empties this worker's tables and gives unused memory back to the system: workers live on from
    one operator to the next."""
    from .hashing import _powers

    _kept.clear()
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Tables of one operator call. They cut the lineage: a lost executor costs the rereading of a
    file, not the recomputation of every step before. The result's own table stays, since the
    result is lazy; `drop` deletes those that it doesn't need."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/quill/{name}-{uuid.uuid4().hex}"
        small_batches(spark)

    def put(self, df: DataFrame, table: str) -> DataFrame:
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").parquet(self.path(table))
        return self.get(table, df)

    def get(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def path(self, table: str) -> str:
        return f"{self.top}/{table}"

    def drop(self, *tables: str) -> None:
        for t in tables:
            drop_path(self.spark, self.path(t))


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """While a table is written, its shuffle files go as soon as it is complete."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, though the body uses it in a lambda's loop."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges(a, b) reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): a logarithmic number of
    rounds for chains too. Each star takes a node's smallest neighbour by a grouped minimum with
    map-side combining and joins it back, so that a hub's links never meet in one task: adaptive
    execution splits the skewed join. Rounds are tables in the shared folder."""
    spark = scratch.spark
    edges = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0")
    k, before = 0, None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: each larger neighbour of u hangs on u's smallest.
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.put(large.where("a <> b").distinct(), f"cc{k}l")
        # Small star: u and its smaller neighbours hang on the smallest of them.
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = scratch.put(small.union(low.select("u", "m")).where("a <> b").distinct(), f"cc{k + 1}")
        got = small.agg(F.count("*").alias("n"), F.sum("b").alias("s"), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)).alias("h")).collect()[0]
        scratch.drop(f"cc{k}", f"cc{k}l")
        edges, k = small, k + 1
        if got == before:
            break
        before = got
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

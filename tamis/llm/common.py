"""What the operators share: session limits, cut lineage, global order, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of characters other than ASCII white space.
SPACE = r"\x20\x09-\x0D"
#: A Python worker gets at most this much text at once (one longer row still comes alone).
BATCH_BYTES = 2 << 20
BATCH_ROWS = 1000
#: Tables of at most this many rows may be broadcast, behind a count; larger ones are shuffled.
BROADCAST_ROWS = 200_000

_roots: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Bound what Arrow hands to a Python worker at once, so that long texts can't exhaust it. Plans read these settings of
    the session when they run, so they stay; tighter ones of the caller's are left."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(name))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def _root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a local folder only where that is unset and the master local."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}/checkpoints"
        _roots[app] = f"{base.rstrip('/')}/tamis-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what is staged by now. Executors keep those until the driver's JVM has collected what
    refers to them, which it may not do for half an hour. The scheduler refers to its last job: a small one takes that place."""
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()


class Stage:
    """A DataFrame written as Parquet to the shared folder and read again: its lineage is cut there."""

    def __init__(self, df: DataFrame, name: str, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{_root(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        write = df.write.partitionBy(partition_by) if partition_by else df.write
        write.parquet(self.path)
        schema = df.schema
        if partition_by:
            schema = T.StructType([f for f in schema if f.name != partition_by] + [schema[partition_by]])
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stage(df: DataFrame, name: str) -> DataFrame:
    return Stage(df, name).df


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is known to have at most BROADCAST_ROWS rows, else df: the join then shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. One pass: each word with the space around it becomes one character."""
    each = F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "a")
    return F.when(text.rlike(f"[^{SPACE}]"), F.length(each)).otherwise(0).cast("long")


def unit(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _sorted(df: DataFrame, keys: list[Column], out: Column, total: Column, name: str) -> DataFrame:
    """df with a window's `out` over the order of keys. No task sorts everything: ranges are summed apart (total, by the
    same measure) and shifted by what lies before, of which there is as much as there are shuffle partitions."""
    part = stage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = part.groupBy("_part").agg(total.alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = out.over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_part", "_place", "_before")


def ranked(df: DataFrame, keys: list[Column], out: str) -> DataFrame:
    """df with `out`, each row's 0-based place in the order of keys."""
    return _sorted(df, keys, F.count("*"), F.count("*"), out).withColumn(out, F.col(out) - 1)


def running(df: DataFrame, keys: list[Column], value: str, out: str) -> DataFrame:
    """df with `out`, the sum of a whole-number column up to each row in the order of keys, itself included."""
    return _sorted(df, keys, F.sum(value), F.sum(value), out)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node of its component.

    Large-star, small-star: each round a node's larger neighbours, then its smaller ones, are linked to its smallest.
    Sums and joins only: no node's neighbours are ever gathered in a task. Rounds grow with the logarithm of the
    component sizes; each round is written to the shared folder. The smallest neighbours are broadcast while a count of
    the links says that they are few.
    """
    e = Stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _sum(e.df)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.df.unionByName(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.df.select(F.col("u"), F.col("v")).join(bounded(least.withColumnRenamed("u", "v"), 2 * before[0]), "v").select("u", F.col("m").alias("v"))
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        big = Stage(large.unionByName(own).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        low = big.df.groupBy("u").agg(F.min("v").alias("m"))
        small = big.df.join(bounded(low, 2 * before[0]), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        e.drop()
        big.drop()
        e, now = new, _sum(new.df)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sum(e: DataFrame) -> tuple:
    """A fingerprint of a set of links."""
    got = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first()
    return tuple(got)


def texts(batches: Iterator, column: int) -> Iterator:
    """Arrow batches with one column as Python strings."""
    for batch in batches:
        yield batch, batch.column(column).to_pylist()


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives the memory it freed back when a task ends: Python workers are used again, and
    would hold on to what an earlier step needed most."""

    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return out

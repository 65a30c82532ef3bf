"""Sharding by sampled splitters: records are range-partitioned by key, so that the shards' bytes are near equal.

The key is a hash of the text, then the record's own key: equal texts lie together, and a text that is as common as a
shard or more is still cut, by the records' keys. A size-weighted sample of keys gives the splitters of many small ranges;
ranges that come out overfull are cut again by a sample of their own. Prefix sums over the ranges, then within each, give
every record's exact place in bytes and rows, and so its shard and slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, stage, tidy

#: Ranges at least, records of a range on average beyond that, sample keys for a range, and what counts as overfull.
RANGES, RANGE_ROWS, SAMPLES, OVERFULL = 1024, 1 << 19, 16, 3.0
KEYS = ["a", "b", "c"]


def _splitters(sample: list[tuple], n: int) -> np.ndarray:
    """n - 1 keys at the quantiles of a sample whose members weigh alike."""
    keys = np.array(sorted(sample), dtype="i8,i8,i8")
    at = (np.arange(1, n) * len(keys)) // n
    return keys[at] if len(keys) else keys


def _place(df: DataFrame, splitters: np.ndarray, column: str) -> DataFrame:
    """df with the number of the range that each key falls into, by binary search."""
    held = df.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        uniq = np.unique(s["f0"])
        for batch in batches:
            keys = np.empty(batch.num_rows, dtype="i8,i8,i8")
            for f, c in zip(("f0", "f1", "f2"), KEYS, strict=True):
                keys[f] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            # most keys are told apart by their first part; the rest compare in full
            out = np.searchsorted(s["f0"], keys["f0"], "right")
            tied = np.flatnonzero(np.isin(keys["f0"], uniq))
            if len(tied):
                out[tied] = np.searchsorted(s, keys[tied], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, column])

    return df.mapInArrow(tidy(run), ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", {column} int")


def _drawn(df: DataFrame, rate: float, salt: int) -> list[tuple]:
    """Keys drawn with a chance of size * rate each, as often as whole multiples of that say."""
    u = F.shiftrightunsigned(F.xxhash64("a", "b", "c", F.lit(salt)), 11) / F.lit(float(1 << 53))
    times = F.floor(F.col("size") * F.lit(rate) + u).cast("int")
    got = df.select(*KEYS, times.alias("n")).where("n > 0").collect()
    return [(r.a, r.b, r.c) for r in got for _ in range(r.n)]


def shard(df: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot): shard 0 to shards - 1, slot gapless from 0 within it.

    Size is the text's UTF-8 bytes plus 1, a null text has none: size 1, and no crc32. A shard's bytes differ from an equal share
    by at most about one record, however even the ranges are: those too large are cut again up to three times, and then taken
    as they are. Records alike in key and text tie; they are interchangeable. A null key is one more
    key. An empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col(text).cast("binary")).alias("crc"), F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.col(key)).alias("b"))
    # c tells records apart that are alike in all else, so that any run of them can be cut
    rows = stage(rows.withColumn("c", F.monotonically_increasing_id()), "records")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(RANGES, -(-count // RANGE_ROWS))
    splitters = _splitters(_drawn(rows, ranges * SAMPLES / max(1, total), 3), ranges)
    for salt in range(4, 8):
        placed = Stage(_place(rows, splitters, "range"), "placed")
        sums = {r.range: (r.bytes, r.rows) for r in placed.df.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        over = [k for k, (b, n) in sums.items() if n > 64 and b > OVERFULL * total / ranges]
        if not over or salt == 7:
            break
        more = _drawn(placed.df.where(F.col("range").isin(over)), ranges * SAMPLES / total, salt)
        splitters = np.unique(np.concatenate([splitters, _splitters(more, max(2, 2 * len(more) // SAMPLES))]))
        placed.drop()
    bytes_, rows_, table = 0, 0, []
    for k in sorted(sums):
        table.append((k, bytes_, rows_))
        bytes_, rows_ = bytes_ + sums[k][0], rows_ + sums[k][1]
    before = df.sparkSession.createDataFrame(table, "_range int, _bytes long, _rows long")  # a row for each range
    inside = Window.partitionBy("range").orderBy(*KEYS)
    run = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    got = placed.df.withColumn("_in", run).withColumn("_nth", F.row_number().over(inside) - 1).join(F.broadcast(before), F.col("range") == F.col("_range"))
    middle = F.col("_bytes") + F.col("_in") - F.col("size") / 2
    got = got.select("key", "size", "crc", F.least(F.floor(middle * shards / F.lit(float(max(1, total)))), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("_rows") + F.col("_nth")).alias("place"))
    got = stage(got, "places")
    first = got.groupBy("shard").agg(F.min("place").alias("_first")).withColumnRenamed("shard", "_shard")
    return got.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("_first")).cast("long").alias("slot"))

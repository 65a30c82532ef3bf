"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash; each has a virtual finish time, the source's cumulative tokens up to its end
divided by the source's target. All are then sorted by that time, over ranges of it, and served until the total budget is
spent: running sums of the sorted ranges say where that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, running, stage, unit, word_count

#: Rows that one shuffled bucket of a source holds on average, as long as it has at most BUCKETS of them.
BUCKET_ROWS, BUCKETS = 128, 1 << 16


def targets(sources: DataFrame, budget: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, n, target): the budget shared by weight, none above cap times its source's size.

    Sources in order of code point, null last, weigh `weights`, repeating. What a capped source can't take is shared
    anew by weight until none is above its cap, each time from sums over all sources: sources stay distributed.
    """
    order = [F.col("source").asc_nulls_last()]
    s = ranked(sources, order, "_nth").withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nth") % len(weights) + 1).cast("int")))
    s = stage(s.withColumn("limit", F.col("source_size") * F.lit(cap)), "sources")
    total = budget * float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    rate = 0.0
    while True:
        full = F.col("w") * F.lit(rate) >= F.col("limit")
        used, weight = s.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not weight:
            break
        new = max(rate, (total - used) / weight)
        if new <= rate:
            break
        rate = new
    return s.select("source", "source_size", "n", F.least("limit", F.col("w") * F.lit(rate)).alias("target"))


def plan(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", budget: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: int = 2, seed: int = 1) -> DataFrame:
    """(key, source, tie, size, source_size, target, copies) for each row: how often the mix takes it, 0 to cap times.

    A null or wordless text has size 0 and is not taken. Null sources are one source. Rows alike in key, source and text are
    one document of their joint size: all are taken, or none. A source's taken words differ from its target by about a
    document. Reruns give the same rows. Extra columns are not read; an empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("tie"))
    rows = stage(rows.groupBy("key", "source", "tie", "size").agg(F.count("*").alias("rows")), "sizes")
    words = F.col("size") * F.col("rows")
    sums = stage(targets(rows.groupBy("source").agg(F.sum(words).alias("source_size"), F.count("*").alias("n")), budget, weights, cap), "targets")
    dealt = rows.join(sums.withColumnRenamed("source", "_source"), rows.source.eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("u", unit(F.col("tie"), F.lit(seed))).withColumn("bucket", F.floor(F.col("u") * F.least(F.lit(BUCKETS), F.ceil(F.col("n") / BUCKET_ROWS))).cast("int"))
    parts = dealt.groupBy("source", "bucket").agg(F.sum(words).alias("_sum"))
    parts = parts.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("bucket")) - F.col("_sum")).select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "_before")
    within = F.sum(words).over(Window.partitionBy("source", "bucket").orderBy("u", "tie").rowsBetween(Window.unboundedPreceding, 0))
    timed = dealt.withColumn("_sofar", within).join(parts, dealt.source.eqNullSafe(F.col("_source")) & (dealt.bucket == F.col("_bucket")))
    timed = stage(timed.withColumn("sofar", F.col("_sofar") + F.col("_before")).select("key", "source", "tie", "size", "rows", "source_size", "target", "sofar"), "timed")
    last = _cut(timed, cap, float(sums.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]))
    place = lambda e: F.struct(_finish(e).alias("f"), F.col("tie").alias("tie"), F.lit(e).alias("e"))
    cut = None if last is None else F.struct(F.lit(last[0]).alias("f"), F.lit(last[1]).alias("tie"), F.lit(last[2]).alias("e"))
    copies = F.lit(0) if cut is None else sum((F.when(place(e) <= cut, 1).otherwise(0) for e in range(cap)), F.lit(0))
    out = timed.withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0))
    each = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))
    return out.select("key", "source", "tie", "size", "source_size", "target", "copies", each.alias("_nth")).drop("_nth")


def _finish(epoch: int) -> Column:
    """Virtual finish time of a document's copy in an epoch: 1 when its source has had its target."""
    return (F.col("sofar") + epoch * F.col("source_size")) / F.col("target")


def _cut(timed: DataFrame, cap: int, budget: float) -> tuple[float, int, int] | None:
    """Finish time, tie and epoch of the last copy that fits the budget, when all are served in that order; None if none
    fits. Running sums over sorted ranges: no task sees all copies."""
    copies = F.explode(F.array(*[F.struct(_finish(e).alias("f"), F.lit(e).alias("e")) for e in range(cap)]))
    served = timed.where("size > 0 and target > 0").select((F.col("size") * F.col("rows")).alias("words"), "tie", copies.alias("c")).select("words", "tie", "c.f", "c.e")
    run = running(served, [F.col("f"), F.col("tie"), F.col("e")], "words", "run")
    got = run.where(F.col("run") <= F.lit(budget)).agg(F.max(F.struct("f", "tie", "e")).alias("last")).first()["last"]
    return None if got is None else (got["f"], got["tie"], got["e"])


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The rows of df as often as the mix takes them, with all their columns, whatever their names."""
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    t, s, k = (F.col(f"c{df.columns.index(n)}") for n in (text, source, key))
    taken = plan(df, text, source, key, **how).where("copies > 0").groupBy("key", "source", "tie").agg(F.max("copies").alias("copies"))
    got = own.join(taken, (F.xxhash64(k, t) == F.col("tie")) & k.eqNullSafe(F.col("key")) & s.eqNullSafe(F.col("source")))
    rows = got.select(*own.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("nth")).drop("nth")
    return rows.toDF(*df.columns)

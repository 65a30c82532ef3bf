"""Steps over streams. They keep no state, so a stream is cleaned by the columns that a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tamis.plans.runner import Runner, apply, named


def clean(stream: DataFrame, column: str, step: object, **how) -> DataFrame:
    """The stream with cleaned, issues and is_valid."""
    return apply(stream, column, step, **how)


def quarantine(stream: DataFrame, column: str, step: object, good: str, bad: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write good rows and bad rows of a stream to two Parquet tables. Each batch goes to a folder of its own, written over
    if the batch is tried again, so that no row is written twice."""

    def batch(df: DataFrame, number: int) -> None:
        r = Runner(step, df, column)
        out, ok = r.collect().persist(), named(r.names[2])
        try:
            out.where(ok).drop(*r.names[1:]).write.mode("overwrite").parquet(f"{good}/batch={number}")
            out.where(~ok).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            out.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

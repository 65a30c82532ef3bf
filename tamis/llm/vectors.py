"""What the two embedding operators share: which vectors take part, and blocks of rows packed into one."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """True for a vector without null or non-finite components that is not zero; false, never null, for all others."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    ok = vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def width(df: DataFrame, vector: str) -> int:
    """The most common number of components of vectors that take part (the smaller of equally common ones); 0 if none."""
    got = df.where(takes_part(F.col(vector))).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return got["d"] if got else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def chunks(batches: Iterator[pa.RecordBatch], rows: int, of: int = 0) -> Iterator[pa.Table]:
    """The stream cut into tables of at most `rows` rows; rows of a table agree in the first `of` columns."""
    held: list[pa.RecordBatch] = []
    size, now = 0, None

    def cut() -> Iterator[pa.Table]:
        nonlocal held, size
        if size:
            yield pa.Table.from_batches(held).combine_chunks()
        held, size = [], 0

    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:of]), strict=True)) if of else [()] * batch.num_rows
        at = 0
        for key, group in itertools.groupby(keys):
            n = len(list(group))
            if key != now:
                yield from cut()
                now = key
            while n:
                take = min(n, rows - size)
                held.append(batch.slice(at, take))
                at, n, size = at + take, n - take, size + take
                if size == rows:
                    yield from cut()
    yield from cut()

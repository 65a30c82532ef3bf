"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Rows of a label are sorted by a first projection and cut into blocks, and these into strips; two strips meet if a
query-centred window around rows of one reaches the other. Where blocks of two strips meet, each of PROJECTIONS more
projections is sorted, and a row's window of it gives a collision to each row within WINDOW standard deviations of what a
pair at the threshold has. Pairs with COLLISIONS of them are verified by exact cosine. A pair at the threshold passes with a
chance of over 1 - 1e-5; nearer pairs with a higher one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, stage, tidy, tune
from .vectors import chunks, matrix, takes_part, width

PROJECTIONS, WINDOW, COLLISIONS, FIRST = 16, 2.5, 12, 5.0
#: Rows of a block, blocks of a strip, and rows that are compared at once. Each strip travels once for each it meets.
ROWS, STRIP, TILE = 4096, 16, 1024


def projections(d: int, seed: int = 17) -> np.ndarray:
    """Unit directions, d x (1 + PROJECTIONS); the first sorts the rows."""
    p = np.random.default_rng(seed).normal(size=(d, 1 + PROJECTIONS))
    return p / np.linalg.norm(p, axis=0)


def windows(d: int, similarity: float) -> tuple[float, float]:
    """Half-widths for the sorting projection and the others. No difference exceeds the pair's distance."""
    distance = np.sqrt(max(0.0, 2 - 2 * similarity)) + 1e-7
    return min(distance, FIRST * distance / np.sqrt(max(1, d))), min(distance, WINDOW * distance / np.sqrt(max(1, d)))


def collisions(za: np.ndarray, zb: np.ndarray, width: float) -> np.ndarray:
    """How many projections put row and column into one window: each is sorted, and a row's window is a range of places."""
    hits = np.zeros((len(za), len(zb)), np.uint8)
    place = np.empty(len(zb), np.uint16)
    for a, b in zip(za.T, zb.T, strict=True):
        order = np.argsort(b, kind="stable")
        place[order] = np.arange(len(b), dtype=np.uint16)
        first, last = np.searchsorted(b[order], a - width, "left"), np.searchsorted(b[order], a + width, "right")
        hits += place[None] - first.astype(np.uint16)[:, None] < (last - first).astype(np.uint16)[:, None]
    return hits


def forest(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the rows and columns joined by links, as (0-based row or rows + column, first of its tree)."""
    n, m = links.shape
    todo = links.any(1)
    while todo.any():
        first = int(todo.argmax())
        rows = np.zeros(n, bool)
        rows[first] = True
        new, cols = rows.copy(), np.zeros(m, bool)
        while new.any():
            reach = links[new].any(0) & ~cols
            cols |= reach
            new = links[:, reach].any(1) & ~rows
            rows |= new
        todo &= ~rows
        yield from ((int(i), first) for i in np.flatnonzero(rows) if i != first)
        yield from ((n + int(j), first) for j in np.flatnonzero(cols))


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", similarity: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) for each row: how many other vectors it links with directly, and the smallest
    key reachable by links.

    Two rows link if their labels are equal and not null and their cosine, in double precision, reaches the similarity.
    Vectors that are null, zero, of an uncommon length or hold null or non-finite components, and rows with a null key,
    link with nothing; each is its own component. Equal vectors of a label are one class, compared once and counted as
    often as they occur. Rows with one key count as one node of the components.
    """
    spark = df.sparkSession
    tune(spark)
    d = width(df, vector)
    ok = takes_part(F.col(vector)) & (F.size(vector) == d) & F.col(key).isNotNull() & F.col(label).isNotNull()
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(ok, F.col(label)).alias("label"), F.when(ok, F.col(vector)).alias("v"))
    classes = stage(rows.where(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("times")), "classes")
    first, other = windows(d, similarity)
    p = spark.sparkContext.broadcast(projections(max(1, d)))
    # vectors travel as they came, single or double
    form = np.dtype(np.float32 if dict(df.dtypes)[vector] == "array<float>" else np.float64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), d)
            z = v @ p.value[:, 0] / np.linalg.norm(v, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z), batch.column(2), batch.column(3), pa.array([x.tobytes() for x in v.astype(form)], pa.binary())], names=["label", "z", "id", "times", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, ROWS, 1):
            z = t.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().slice(0, 1), pa.array([z.min()]), pa.array([z.max()]), pa.array([t.column(2).to_numpy().tobytes()], pa.binary()), pa.array([t.column(3).to_numpy().tobytes()], pa.binary()), pa.array([b"".join(t.column(4).to_pylist())], pa.binary())], names=["label", "low", "high", "ids", "times", "v"])

    kind = dict(rows.dtypes)["label"]
    sorted_ = classes.select("label", "v", "id", "times").mapInArrow(tidy(project), f"label {kind}, z double, id long, times long, v binary").repartitionByRange("label", "z").sortWithinPartitions("label", "z")
    blocks = stage(sorted_.mapInArrow(tidy(pack), f"label {kind}, low double, high double, ids binary, times binary, v binary").withColumn("b", F.monotonically_increasing_id()), "blocks")
    strip = F.floor((F.row_number().over(Window.partitionBy("label").orderBy("low", "b")) - 1) / STRIP)
    ends = stage(blocks.select("label", "b", "low", "high").withColumn("s", strip), "strips")
    strips = ends.groupBy("label", "s").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    x, y = strips.alias("x"), strips.alias("y")
    meet = (F.col("x.label") == F.col("y.label")) & (F.col("x.s") <= F.col("y.s")) & (F.col("y.low") - F.col("x.high") <= first) & (F.col("x.low") - F.col("y.high") <= first)
    cells = stage(x.join(y, meet).select(F.col("x.label").alias("label"), F.col("x.s").alias("s1"), F.col("y.s").alias("s2")).withColumn("cell", F.monotonically_increasing_id()), "cells")
    sides = cells.select("label", F.col("s1").alias("s"), "cell", F.lit(0).alias("side")).unionByName(cells.where("s1 <> s2").select("label", F.col("s2").alias("s"), "cell", F.lit(1).alias("side")))
    alone = cells.where("s1 = s2").select(F.col("cell").alias("_cell"))
    places = ends.select("label", "s", "b").join(sides, ["label", "s"]).select("b", "cell", "side")
    places = places.join(alone, F.col("cell") == F.col("_cell"), "left").select("b", "cell", F.when(F.col("_cell").isNotNull(), 2).otherwise(F.col("side")).alias("side"))
    met = blocks.select("b", "low", "high", "ids", "times", "v").join(places, "b").repartition("cell").sortWithinPartitions("cell", "side", "b").select("cell", "side", "low", "high", "ids", "times", "v")

    def tiles(ids: bytes, times: bytes, v: bytes, low: float, high: float) -> list[dict]:
        """A block cut into tiles, each with its projections."""
        ids, times, v = np.frombuffer(ids, np.int64), np.frombuffer(times, np.int64), np.frombuffer(v, form).reshape(-1, d)
        out = []
        for i in range(0, len(ids), TILE):
            w = v[i : i + TILE].astype(np.float64)
            size = np.linalg.norm(w, axis=1)
            z = w @ p.value / size[:, None]
            out.append({"ids": ids[i : i + TILE], "times": times[i : i + TILE], "v": v[i : i + TILE], "size": size, "z": z[:, 1:].astype(np.float32), "low": z[:, 0].min(), "high": z[:, 0].max()})
        return out

    def link(a: dict, b: dict) -> tuple[np.ndarray, ...] | None:
        """(ids, counts) of what links and (ids, roots) of a forest of the links, between two tiles or within one."""
        if b["low"] - a["high"] > first or a["low"] - b["high"] > first:
            return None
        links = collisions(a["z"], b["z"], np.float32(other)) >= COLLISIONS
        if a is b:
            np.fill_diagonal(links, False)
        if not links.any():
            return None
        links &= (a["v"].astype(np.float64) @ b["v"].astype(np.float64).T) / (a["size"][:, None] * b["size"][None]) >= similarity
        tree = np.array(list(forest(links)), np.int64).reshape(-1, 2)
        if not len(tree):
            return None
        every = np.concatenate([a["ids"], b["ids"]])
        n = links @ b["times"]
        m = np.zeros(0, np.int64) if a is b else a["times"] @ links
        ids = a["ids"] if a is b else every
        count = np.concatenate([n, m])
        return ids[count > 0], count[count > 0], every[tree[:, 0]], every[tree[:, 1]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for cell, side, low, high, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now:
                    now, held = cell, []
                new = tiles(*block, low, high)
                pairs = [(a, b) for b in new for a in held] if side else []
                if side == 2:
                    pairs += [(a, b) for i, b in enumerate(new) for a in new[: i + 1]]
                if side != 1:
                    held += new
                found = [x for a, b in pairs if (x := link(a, b))]
                if found:
                    ids, n, node, root = (np.concatenate(x) for x in zip(*found, strict=True))
                    ids, at = np.unique(ids, return_inverse=True)
                    tree = np.unique(np.stack([node, root], 1)[node != root], axis=0)
                    n = np.bincount(at, n).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, tree[:, 0]])), pa.array(np.concatenate([n, np.zeros(len(tree), np.int64)])), pa.array(np.concatenate([np.zeros(len(ids), np.int64), tree[:, 1]]), mask=np.arange(len(ids) + len(tree)) < len(ids))], names=["id", "n", "root"])

    found = stage(met.mapInArrow(tidy(compare), "id long, n long, root long"), "found")
    roots = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.where("root is null").groupBy("id").agg(F.sum("n").alias("n"))
    summed = classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    summed = stage(summed.select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("root", "id").alias("root")), "summed")
    out = rows.join(summed, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    own = F.coalesce("root", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("id")).alias("kept"))

"""MinHash near-dedup with HyperMinHash registers.

A document's set of word shingles is hashed to 64 bits; the top bits name one of REGISTERS buckets, and a bucket keeps of
its smallest value the number of leading zeros and MANTISSA bits after the first one: 16 bits. An empty bucket borrows from
the first filled one of a random order of its own, so in sets of any size a register agrees with a chance near the
similarity, and registers do so apart from each other. BANDS of four registers are 64-bit keys; documents that share a key are candidates, which must pass
an estimate of their similarity (corrected for registers that agree by chance), then the exact similarity of full sets.

Documents with equal sets are one class, of which one member is compared. Classes that meet under a key are first paired
with a centre of the key's classes, and the nearest such pair of each is verified. Where a key's classes still lie in
different components, all pairs between those are estimated; what passes ties components to clusters, and in each cluster
the full sets of the classes concerned are compared block by block. So no group's pairs are ever rows, and no pair that
shares a key and passes the estimate is left out.

Sets so small that no unequal ones reach the similarity (3 shingles and less at 0.8) have no keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, bounded, components, release, stage, tidy, tune
from .letters import SPACES, runs

REGISTERS, MANTISSA, BANDS = 128, 10, 32
#: Estimates may fall short of the threshold by so many standard errors.
SLACK = 4.5
#: Classes under one key that are estimated together; of more, each two parts of that size meet.
CHUNK = 2048
#: Classes, and bytes of sets, of a block; shingles that two blocks are compared by at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 4 << 20, 2048
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = np.uint64(0x9E3779B97F4A7C15)

_order = np.random.default_rng(20).permutation(REGISTERS)
#: For each bucket, the buckets that it asks for a register, in order.
_probes = np.random.default_rng(21).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_bytes = _mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_blank = np.zeros(256, bool)
_blank[SPACES] = True
_powers = [np.ones(1, np.uint64)]


def _power(n: int) -> np.ndarray:
    """1, K, K**2 ... for an odd K, n of them at least."""
    if len(_powers[0]) < n:
        _powers[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, 0xD6E8FEB86659FD93, np.uint64)]), dtype=np.uint64)
    return _powers[0]


def shingles(part: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of k words (of all its words, if fewer)."""
    for text in part:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        first, last = runs(~_blank[raw])
        n = len(first)
        if not n:
            yield np.empty(0, np.uint64)
            continue
        size = last - first
        place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))[: len(raw) - first[0]] if first[0] == 0 else np.concatenate([np.zeros(first[0], np.int64), np.arange(first[0], len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))])
        value = np.where(_blank[raw], np.uint64(0), _bytes[_lower[raw]] * _power(int(place.max()) + 1)[place])
        word = _mixed(np.add.reduceat(value, first) + size.astype(np.uint64) * ODD)
        w = min(n, k)
        out = np.full(n - w + 1, w, np.uint64)
        for j in range(w):
            out = _mixed(out * ODD + word[j : n - w + 1 + j])
        yield np.unique(out)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS 16-bit registers for each set, in the order of bands; an empty set's row is 0."""
    bits = REGISTERS.bit_length() - 1
    rest = np.uint64((1 << (64 - bits)) - 1)
    least = np.full((len(sets), REGISTERS), EMPTY)
    heads = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - bits)
    for row, s in zip(least, sets, strict=True):
        if len(s):
            at = np.searchsorted(s, heads)
            some = at < np.append(at[1:], len(s))
            row[some] = s[at[some]] & rest
    filled = least != EMPTY
    high = np.frexp(np.where(filled, least, 1).astype(float))[1]
    zeros = np.clip(64 - bits - high, 0, 62)
    shift = np.maximum(high - 1 - MANTISSA, 0).astype(np.uint64)
    reg = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | ((least >> shift) & np.uint64((1 << MANTISSA) - 1))
    # an empty bucket takes the register of the first filled one that it asks, changed by that one's number
    donor = np.where(filled, np.arange(REGISTERS), -1)
    left = np.flatnonzero(filled.any(1) & ~filled.all(1))
    for ask in _probes.T:
        if not len(left):
            break
        own = donor[left]
        donor[left] = np.where((own < 0) & filled[left][:, ask], ask, own)
        left = left[(donor[left] < 0).any(1)]
    away = np.where((donor < 0) | filled, 0, donor + 1).astype(np.uint64)
    got = np.take_along_axis(reg, np.maximum(donor, 0), 1)
    return ((got + away * np.uint64(40503)) & np.uint64(0xFFFF)).astype(np.uint16)[:, _order]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets of n and m shingles from the share of equal registers, less those equal by chance."""
    equal = (a == b).mean(-1)
    chance = np.zeros(np.broadcast(n, m).shape)
    x, y = np.maximum(n / REGISTERS, 0.2), np.maximum(m / REGISTERS, 0.2)
    for z in range(40):
        low, top = 2.0 ** -(z + 1), 2.0**-z
        chance = chance + (np.exp(-x * low) - np.exp(-x * top)) * (np.exp(-y * low) - np.exp(-y * top))
    chance = np.minimum(0.5, chance / (1 << MANTISSA))
    return (equal - chance) / (1 - chance)


def least_estimate(similarity: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the estimate of a pair at the threshold reaches almost surely; few shingles fill few registers."""
    k = np.minimum(REGISTERS, np.maximum(1, np.minimum(n, m)) / 2)
    return similarity - SLACK * np.sqrt(similarity * (1 - similarity) / k)


def _signed(df: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """(key, n, node, regs): node is a 128-bit hash of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingles(batch.column(1).to_pylist(), k))
            regs = registers(sets)
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary())], names=["key", "n", "node", "regs"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(tidy(run), f"key {dict(df.dtypes)[key]}, n long, node binary, regs binary")


def _keys(classes: DataFrame, similarity: float) -> DataFrame:
    """(band, slot, node, n): a row for each band of each class that may be similar to another: of n and n + 1 shingles at
    most n are common."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring(F.col("regs"), b * 8 + 1, F.lit(8)))
    likely = classes.where(100 * F.col("n") >= round(100 * similarity) * (F.col("n") + 1))
    return likely.select("node", "n", F.posexplode(bands).alias("band", "slot"))


def _estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, e) of those pairs of nodes that may reach the similarity by sizes and registers."""
    c = classes.select("node", "n", "regs")
    both = pairs.join(c.toDF("a", "na", "ra"), "a").join(c.toDF("b", "nb", "rb"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            n, m = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            e = estimate(ra, rb, n, m)
            some = pa.array(e >= least_estimate(similarity, n, m))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some), pa.array(e).filter(some)], names=["a", "b", "e"])

    return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(tidy(run), "a binary, b binary, e double")


def _sets(nodes: DataFrame, docs: DataFrame, text: str, key: str, k: int, held: list[Stage]) -> DataFrame:
    """(node, s): the full sets of nodes, which come with the key of a document. Only those documents are read again."""
    few = bounded(nodes.select(F.col("key").alias("_key"), "node"), nodes.count())
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(few, F.col("_k").eqNullSafe(F.col("_key"))).select("node", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [s.tobytes() for s in shingles(batch.column(1).to_pylist(), k)]
            # a key that stands for several texts brings them all: the right one has the node's hash
            some = pa.array([hashlib.blake2b(s, digest_size=16).digest() == x for s, x in zip(got, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), pa.array(got, pa.binary()).filter(some)], names=["node", "s"])

    held.append(Stage(own.mapInArrow(tidy(run), "node binary, s binary").dropDuplicates(["node"]), "sets"))
    return held[-1].df


def _reach(both: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Do sets of n and m shingles with `both` in common reach the similarity? Exact for hundredths."""
    return 100 * both >= round(100 * similarity) * (n + m - both)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, k: int, similarity: float, held: list[Stage]) -> DataFrame:
    """Those pairs whose full sets reach the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(classes.select("node", "key"), "node")
    held.append(Stage(nodes, "nodes"))
    full = _sets(held[-1].df, docs, text, key, k, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                some.append(_reach(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(some, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b").join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of a sorted stream that agree in their first `of` columns, as lists of columns."""
    now, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:of] != now:
                if held:
                    yield now, held
                now, held = row[:of], [[] for _ in columns[of:]]
            for c, x in zip(held, row[of:], strict=True):
                c.append(x)
    if held:
        yield now, held


def _stars(x: np.ndarray, y: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
    """Links x - y between names as (a, b): each name beside the smallest that it is joined with."""
    root = list(range(len(names)))
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            if names[p] < names[q]:
                p, q = q, p
            root[p] = q
    for i in range(len(root)):
        p = i
        while root[p] != p:
            p = root[p]
        root[i] = p
    tied = [i for i, p in enumerate(root) if p != i]
    return pa.RecordBatch.from_arrays([pa.array([names[i] for i in tied], pa.binary()), pa.array([names[root[i]] for i in tied], pa.binary())], names=["a", "b"])


def _cells(keys: DataFrame, comps: DataFrame, by: list[str]) -> DataFrame:
    """(by, cell, part, node, comp) of keys whose classes lie in different components; each two parts of a key's classes
    meet in a cell of their own."""
    rows = keys.join(comps, "node")
    sums = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    rows = rows.join(sums, by)
    parts = F.ceil(F.col("rows") / CHUNK).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part")))
    return rows.withColumn("cell", F.explode(cells)).select(*by, "cell", "part", "node", "comp")


def _contested(keys: DataFrame, comps: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(kind, a, b) of classes of different components that share a key and may reach the similarity: kind 0 ties
    components a and b, a star for each tree of a key; kind 1 says that class a of component b is in such a pair."""
    by = ["band", "slot"]
    rows = _cells(keys, comps, by).join(classes.select("node", "n", "regs"), "node").select(*by, "cell", "part", "node", "comp", "n", "regs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (part, node, comp, n, regs) in _groups(batches, 3):
            index: dict[bytes, int] = {}
            c = np.array([index.setdefault(x, len(index)) for x in comp])
            if len(index) < 2:
                continue
            r, n, part_ = np.frombuffer(b"".join(regs), np.uint16).reshape(-1, REGISTERS), np.array(n, float), np.array(part)
            across = len(set(part)) > 1
            asked, ties = np.zeros(len(n), bool), []
            step = max(1, (1 << 18) // len(n))
            for i in range(0, len(n), step):
                mine = np.arange(i, min(i + step, len(n)))
                ok = (c[mine, None] != c[None, :]) & (mine[:, None] < np.arange(len(n))) & (np.minimum(n[mine, None], n) >= (similarity - 1e-9) * np.maximum(n[mine, None], n))
                if across:
                    ok &= part_[mine, None] != part_[None, :]
                x, y = np.nonzero(ok)
                x = mine[x]
                for j in range(0, len(x), 1 << 14):
                    p, q = x[j : j + (1 << 14)], y[j : j + (1 << 14)]
                    some = estimate(r[p], r[q], n[p], n[q]) >= least_estimate(similarity, n[p], n[q])
                    p, q = p[some], q[some]
                    asked[p] = asked[q] = True
                    ties.append(np.unique(c[p] * len(index) + c[q]))
            ties_ = np.unique(np.concatenate(ties)) if ties else np.empty(0, np.int64)
            x, y = ties_ // len(index), ties_ % len(index)
            tied, nodes = _stars(x, y, list(index)), np.flatnonzero(asked)
            columns = [pa.concat_arrays([c, pa.array([of[i] for i in nodes], pa.binary())]) for c, of in zip(tied.columns, (node, comp), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([0] * tied.num_rows + [1] * len(nodes), pa.int32()), *columns], names=["kind", "a", "b"])

    return rows.repartition(*by, "cell").sortWithinPartitions(*by, "cell").mapInArrow(tidy(run), "kind int, a binary, b binary").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets of a and b have in common."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for sets in (a, b):
        h = np.concatenate(sets)
        sides.append((h, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    cells = []
    for h, row in sides:
        at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
        here = common[at] == h if len(common) else np.zeros(len(h), bool)
        order = np.argsort(at[here], kind="stable")
        cells.append((at[here][order], row[here][order]))
    for first in range(0, len(common), COLUMNS):
        dense = []
        for (at, row), n in zip(cells, out.shape, strict=True):
            s = slice(*np.searchsorted(at, [first, first + COLUMNS]))
            m = np.zeros((n, COLUMNS), np.float32)
            m[row[s], at[s] - first] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _linked(nodes: DataFrame, full: DataFrame, similarity: float, held: list[Stage]) -> DataFrame:
    """Links (a, b) between components of one cluster, from (cluster, comp, node) and the nodes' full sets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(cluster: bytes, part: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([cluster], pa.binary()), pa.array([[c for c, _ in part]], pa.list_(pa.binary())), pa.array([[s for _, s in part]], pa.list_(pa.binary()))], names=["cluster", "comps", "sets"])

        now, held, size = None, [], 0
        for batch in batches:
            for cluster, part, comp, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((cluster, part) != now or len(held) == BLOCK or size + len(s) > BLOCK_BYTES):
                    yield block(now[0], held)
                    held, size = [], 0
                now = cluster, part
                held.append((comp, s))
                size += len(s)
        if held:
            yield block(now[0], held)

    # a cluster's classes are dealt out over as many parts as fill a block each
    sums = nodes.groupBy("cluster").agg(F.ceil(F.count("*") / (BLOCK * 3 // 4)).cast("int").alias("parts"))
    rows = nodes.join(sums, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(full, "node")
    rows = rows.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "comp").select("cluster", "part", "comp", "s")
    held.append(Stage(rows.mapInArrow(tidy(pack), "cluster binary, comps array<binary>, sets array<binary>").withColumn("b", F.monotonically_increasing_id()), "blocks"))
    blocks = held[-1].df
    ends = blocks.select("cluster", "b")
    pairs = ends.toDF("cluster", "b1").join(ends.toDF("cluster", "b2"), "cluster").where("b1 <= b2").select("b1", "b2")
    own = blocks.select("b", "comps", "sets")
    pairs = pairs.join(own.toDF("b1", "c1", "s1"), "b1").join(own.toDF("b2", "c2", "s2"), "b2").select("c1", "s1", "c2", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c1, s1, c2, s2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index: dict[bytes, int] = {}
                i1, i2 = (np.array([index.setdefault(x, len(index)) for x in c]) for c in (c1, c2))
                if len(index) < 2:
                    continue
                a, b = ([np.frombuffer(x, np.uint64) for x in s] for s in (s1, s2))
                n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
                x, y = np.nonzero(_reach(overlaps(a, b), n[:, None], m[None], similarity) & (i1[:, None] != i2[None]))
                ties = np.unique(i1[x] * len(index) + i2[y])
                x, y = ties // len(index), ties % len(index)
                if len(x):
                    yield _stars(x, y, list(index))

    return pairs.mapInArrow(tidy(run), "a binary, b binary")


def _drop(held: list[Stage]) -> None:
    """Folders that nothing reads any more go, and shuffle files with them."""
    spark = held[-1].spark
    while held:
        held.pop().drop()
    release(spark)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row; component_id is the smallest key reachable by links.

    Words are runs of non-space characters, A-Z taken as a-z; a document's set holds its runs of `words` words, or all
    its words as one run if it has fewer. A null or blank text has the empty set: linked with nothing, it is kept and is
    its own component. Equal sets always link, in any number, and so do the rows of one key that have words. A null key is none: it is
    larger than all others: it is a component's id only if there is no other key, and such rows are not kept beside
    others. Extra columns are not read; an empty table gives no rows.
    """
    tune(df.sparkSession)
    held: list[Stage] = []

    def staged(of: DataFrame, name: str) -> DataFrame:
        held.append(Stage(of, name))
        return held[-1].df

    signed = Stage(_signed(df, text, key, words), "registers")
    classes = Stage(signed.df.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    rows = stage(signed.df.select("key", "n", "node"), "rows")
    signed.drop()
    every = _keys(classes.df, similarity)
    shared = every.groupBy("band", "slot").agg(F.count("*").alias("c"), F.min("node").alias("centre")).where("c > 1").drop("c")
    keys = Stage(every.join(shared, ["band", "slot"]).select("band", "slot", "node", "centre"), "keys")
    star = keys.df.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    near = _estimated(star, classes.df, similarity).groupBy("a").agg(F.max_by("b", F.struct("e", "b")).alias("b"))
    links = _verified(staged(near, "pairs"), classes.df, df, text, key, words, similarity, held)
    # unlike sets under one key are one document's
    own = rows.where("key is not null and node is not null").groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("m")).where("b <> m")
    twins = rows.join(own.select(F.col("key").alias("_key"), "b"), F.col("key") == F.col("_key")).where("node <> b").select(F.col("node").alias("a"), "b")
    roots = components(staged(links.unionByName(twins), "links"))
    comps = Stage(classes.df.select("node", "key").join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("comp")), "comps").df
    _drop(held)
    contested = staged(_contested(keys.df.drop("centre"), comps.select("node", "comp"), classes.df, similarity), "contested")
    keys.drop()
    clusters = components(contested.where("kind = 0").select("a", "b")).select(F.col("node").alias("comp"), F.col("root").alias("cluster"))
    nodes = contested.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("comp")).join(clusters, "comp")
    nodes = staged(nodes.join(classes.df.select("node", "key"), "node").select("cluster", "comp", "node", "key"), "nodes")
    classes.drop()
    more = staged(_linked(nodes.drop("key"), _sets(nodes, df, text, key, words, held), similarity, held), "links")
    roots = components(more).select(F.col("node").alias("comp"), "root")
    comps = comps.join(roots, "comp", "left").select("node", "key", F.coalesce("root", "comp").alias("comp"))
    least = comps.groupBy("comp").agg(F.min("key").alias("component_id"))
    of = stage(comps.join(least, "comp").select("node", "component_id"), "components")
    _drop(held)
    out = rows.select("key", "n", "node").join(of, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("key")).alias("kept"))

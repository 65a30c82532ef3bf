"""Operators over embeddings against brute force."""

import numpy as np
import pytest

from tamis.llm import ann, queries, vecdup, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, n int"


def _rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        rows.append((i, rng.normal(size=24).astype(np.float32).tolist(), i % 3))
    base = rng.normal(size=24)
    for i in range(700, 760):  # near copies
        rows.append((i, (base + rng.normal(size=24) * 0.1).astype(np.float32).tolist(), 1))
    for i in range(760, 790):  # exact copies, one of them scaled
        rows.append((i, (np.array(rows[4][1]) * (2 if i == 770 else 1)).tolist(), 1))
    for x in (None, [0.0] * 24, [None, *[1.0] * 23], [float("nan"), *[1.0] * 23], [float("inf"), *[1.0] * 23], [], [1.0, 2.0]):
        rows.append((len(rows) + 10, x, 1))
    rows.append((900, rows[4][1], None))
    return [(*r, "i", "v", 3) for r in rows]


ROWS = _rows()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def good():
    keep = [r for r in ROWS if r[1] is not None and len(r[1]) == 24 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in keep], np.float32).astype(float)
    return keep, x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("small", [False, True])
def test_nearest(table, small, monkeypatch):
    if small:
        monkeypatch.setattr(ann, "ROWS", 40)
        monkeypatch.setattr(ann, "QUERIES", 3)
        monkeypatch.setattr(ann, "SPREAD", 2)
    keep, x = good()
    ids = np.array([r[0] for r in keep])
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = 0
    for q in got:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        want = ids[np.lexsort((ids, -s.round(12)))[:5]]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[np.flatnonzero(ids == m[1])[0]] - m[2]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & set(want))
    assert hits >= 0.9 * 5 * len(got)


def test_codes_favour_products():
    """Anisotropic codes give products of unit vectors with their own kind more exactly than the nearest codewords."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.fit(x)
    error = []
    for passes in (0, 2):
        codes = ann.encode(x, books, passes)
        assert codes.max() < 16
        y = np.concatenate([b[codes[:, m]] for m, b in enumerate(books)], 1)
        error.append(((x * (x - y)).sum(1) ** 2).mean())
        assert np.allclose(np.diag(ann.scan(ann.packed(codes[:50]), ann.tables(x[:50], books))), (x * y).sum(1)[:50], atol=1e-5)
    assert error[1] < error[0]


def test_nearest_ties(spark):
    """Of 300 equal vectors and more that are equal up to their length, the smallest keys are nearest; own rows are none."""
    rng = np.random.default_rng(9)
    hot, other = rng.normal(size=16).astype(np.float32), rng.normal(size=(200, 16)).astype(np.float32)
    rows = [(int(i), hot.tolist()) for i in rng.permutation(300)] + [(300 + i, (hot * 2).tolist()) for i in range(200)] + [(500 + i, v.tolist()) for i, v in enumerate(other)] + [(50, hot.tolist()), (51, hot.tolist())]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == got[250] == got[400] == [0, 1, 2, 3, 4] and len(got) == 14 and all(len(v) == 5 for v in got.values())


@pytest.mark.parametrize("small", [False, True])
def test_nearest_of_narrow_groups(spark, small, monkeypatch):
    """Vectors that are closer together than codewords, some of them equal or equal up to their length: the answer is that of brute force, to the last bit."""
    if small:
        for name, n in (("ROUND_BYTES", 5000), ("STRIP", 50), ("QUERIES", 7), ("PAIRS", 640), ("RERANK", 8)):
            monkeypatch.setattr(ann, name, n)
    rng = np.random.default_rng(11)
    g = rng.normal(size=(2000, 32))
    x = rng.normal(size=(4, 32))[np.arange(2000) % 4] + g * np.array([0.02, 0.001, 1e-5, 0.1])[np.arange(2000) % 4, None]
    x[300:340], x[340:400] = x[300], x[2] * np.arange(1, 61)[:, None]
    x = np.concatenate([x, 20 + g[:1000]]).astype(np.float32)
    ids = rng.permutation(len(x))
    got = {}
    for r in ann.nearest(spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<float>").repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 50))
    y = x.astype(float)
    for at in np.flatnonzero(ids % 50 == 0):
        s = ann.cosine(y, np.broadcast_to(y[at], y.shape))
        s[at] = -9
        order = np.lexsort((ids, -s))[:5]
        assert sorted(got[ids[at]]) == [(i + 1, ids[j], s[j]) for i, j in enumerate(order)]


def test_check_leaves_out_no_pair():
    """Products in single precision, with their error, leave out no pair whose cosine reaches the floor."""
    rng = np.random.default_rng(4)
    for d in (1, 3, 64, 700):
        x = (rng.normal(size=d) * 10.0 ** rng.integers(-3, 4, d) + rng.normal(size=(300, d)) * 1e-4).astype(np.float32).astype(float)
        y = x[:40]
        n, floor = np.arange(300), np.sort(np.stack([ann.cosine(x, np.broadcast_to(q, x.shape)) for q in y]), 1)[:, -4]
        check = ann.Check(np.arange(40), floor, np.full(40, 1 << 40), y, 300)
        check.meet(n, n, np.ones(300, int), x, x / np.linalg.norm(x, axis=1, keepdims=True), (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
        for q in range(40):
            s = ann.cosine(x, np.broadcast_to(y[q], x.shape))
            assert set(check.got[2][check.got[0] == q]) == set(np.flatnonzero(s >= floor[q])) - {q}


def test_recall(spark):
    """Against brute force on the whole table."""
    where = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{where}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in queries.op3_neighbours(spark, where).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert len(got) == (ids % 50 == 0).sum() and hits >= 0.99 * 5 * len(got)


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (3, [1.0, 1.0], 1), (4, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [(r["rank"], r.vec_id) for r in ann.nearest(df).orderBy("rank").collect()] == [(1, 3), (2, 4)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id > 0")).count() == 0


@pytest.mark.parametrize("rows", [1024, 16])
def test_near_duplicates(table, rows, monkeypatch):
    monkeypatch.setattr(vecdup, "ROWS", rows)
    if rows < 1000:
        monkeypatch.setattr(vecdup, "STRIP", 3)
        monkeypatch.setattr(vecdup, "TILE", 5)
    keep, x = good()
    links = {r[0]: set() for r in ROWS}
    s = x @ x.T
    for i, j in zip(*np.nonzero(s >= 0.98), strict=True):
        if i != j and keep[i][2] is not None and keep[i][2] == keep[j][2]:
            links[keep[i][0]].add(keep[j][0])
    root = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo.extend(links[k])
    got = vecdup.near_duplicates(table).collect()
    assert len(got) == len(ROWS) and len(set(root.values())) < len(ROWS) - 60
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), root[r.vec_id], root[r.vec_id] == r.vec_id)


def test_near_duplicates_edges(spark, table):
    assert vecdup.near_duplicates(table.limit(0)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, None, None), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vecdup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 0, None, True), (2, 1, 2, True), (2, 1, 2, True), (3, 0, 3, True)], key=str)


def test_window_keeps_pairs_at_the_threshold():
    """Pairs just at the threshold collide often enough."""
    rng = np.random.default_rng(2)
    d, n = 64, 20_000
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, d))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y
    first, other = vecdup.windows(d, 0.98)
    gap = np.abs((x - y) @ vecdup.projections(d))
    assert (((gap[:, 1:] <= other).sum(1) >= vecdup.COLLISIONS) & (gap[:, 0] <= first)).mean() > 0.9998


def test_collisions():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 6)).astype(np.float32), rng.normal(size=(70, 6)).astype(np.float32)
    b[3:9] = b[3]  # ties
    want = (np.abs(a[:, None].astype(float) - b[None]) <= 0.3).sum(2)
    assert (vecdup.collisions(a, b, 0.3) == want).mean() > 0.999


def test_takes_part(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    keep, _ = good()
    assert df.where(vectors.takes_part(df.embedding)).count() == len(keep) + 1  # and the one of two components
    assert vectors.width(df, "embedding") == 24


def test_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries()) == list(range(1, 11))


def test_sql(spark):
    """What has SQL gives the same rows, on tables with copies, repeats, licence files and links."""
    import duckdb

    where = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, where)
        columns = sorted(df.columns)
        want = c.sql(f"SELECT {', '.join(columns)} FROM ({sql}) q").fetchall()
        assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(map(tuple, want), key=str)

"""Operators over documents against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Public

from tamis.llm import bpe, common, langid, license, minhash, mix, quality, queries, shard, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, t string, node string"


def _documents():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(160):
        rows.append([i, text(rng.randint(1, 120))])
    passage = text(60)
    for i in range(160, 200):
        rows.append([i, f"{text(30)} {passage}\n{text(20)}"])
    near = text(80).split(" ")
    for i in range(200, 230):  # near copies of one text, each unlike the others
        copy = list(near)
        for j in rng.sample(range(80), rng.randint(0, 6)):
            copy[j] = rng.choice(words)
        rows.append([i, " ".join(copy)])
    for i in range(230, 250):  # exact copies
        rows.append([i, rows[3][1]])
    for t in ("", None, "  \t ", "One", "one", "é" * 70, "a b", "A B", "b a", "é" * 70 + "x", text(20_000), "a" * 60_000, "\n".join([text(5)] * 40)):
        rows.append([len(rows), t])
    rng.shuffle(rows)
    return [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "b", "b", "c"][i % 6], 1, "k", 2, "t", "x") for i, t in rows]


ROWS = _documents()
TEXT = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, None, None, None, None, None, None, None)] * 2 + [(None, "some text here", "en", None, 1, None, None, None, None), (7, None, None, None, None, None, None, None, None), (7, "some text here", None, "a", 1, None, None, None, None)], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(links, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


# near copies


def shingled(text, k):
    low = (text or "").translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))
    w = words(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def expected_near(k, similarity):
    sets = {i: shingled(t, k) for i, t in TEXT.items()}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= round(100 * similarity) * len(sets[a] | sets[b])]
    return sets, components(links, TEXT)


@pytest.mark.parametrize(("k", "chunk"), [(2, 2048), (5, 2048), (2, 5)])
def test_near_duplicates(docs, k, chunk, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "BLOCK", min(chunk, 512))
    sets, root = expected_near(k, 0.8)
    got = minhash.near_duplicates(docs, words=k).collect()
    assert len(got) == len(ROWS) and len(set(root.values())) < len(ROWS) - 20
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("chunk", [2048, 20])
def test_short_near_duplicates(spark, chunk, monkeypatch):
    """Pairs at the threshold whose sets fill few registers, 2,000 of them of 4 against 5 shingles, some with words in common
    with all others."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "BLOCK", min(chunk // 3, 512))
    rng = random.Random(6)
    rows = []
    for i in range(2400):
        n = 5 if i < 2000 else 5 * rng.randint(2, 5)
        own = [f"w{rng.randrange(10**9)}" for _ in range(n + 1)]
        if i % 8 == 0:
            own[1:3] = "of", "the"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[: -n // 5]))]
    rows += [(9000 + i, f"of the {i % 7} of the") for i in range(40)]
    sets = {i: shingled(t, 2) for i, t in rows}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    near = {(a, b) for s in by.values() if len(s) < 200 for a in s for b in s if a < b}
    links = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) >= 2400
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == components(links, sets)


def test_registers_of_few_shingles():
    """Pairs at the threshold lose no band key, however few registers they fill."""
    rng = np.random.default_rng(8)
    for both, more in ((4, 1), (8, 2), (12, 3), (24, 6), (96, 24)):
        apart = 0
        x = rng.integers(0, 1 << 63, (5000, both + more), dtype=np.uint64) * np.uint64(2)
        a, b = (minhash.registers([np.sort(s[:n]) for s in x]).reshape(len(x), minhash.BANDS, -1) for n in (both, both + more))
        apart = int((~(a == b).all(2).any(1)).sum())
        assert apart <= 1


def test_rows_of_one_key(spark):
    rows = [(1, "a b c"), (2, "a b c"), (2, "d e f"), (3, "d e f"), (4, "g h")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_near_duplicates_edges(empty, nulls):
    assert minhash.near_duplicates(empty).count() == 0
    got = collections.Counter(tuple(r) for r in minhash.near_duplicates(nulls, words=2).collect())
    assert got == {(None, 0, None, True): 2, (None, 2, 7, False): 1, (7, 0, 7, True): 1, (7, 2, 7, True): 1}


def test_overlaps(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(n)] for n in (9, 5))
    assert minhash.overlaps(a, b).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]
    assert minhash.overlaps(a[:2], b[:1]).tolist() == [[len(set(x) & set(y)) for y in b[:1]] for x in a[:2]]


def test_estimates():
    rng = np.random.default_rng(0)
    for n, share in ((2000, 0.9), (500, 0.8), (60, 0.8)):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, round(n * share), dtype=np.uint64) * np.uint64(2)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = minhash.registers([a, b])
            errors.append(minhash.estimate(x, y, np.array(len(a)), np.array(len(b))) - j)
        assert abs(np.mean(errors)) < 0.06


# repeats


def expected_repeats(length):
    seen, out = {}, {}
    for i, t in sorted(TEXT.items()):
        raw = (t or "").encode()
        off, mine = np.zeros(len(raw), bool), []
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if w in seen:
                off[j : j + length] = True
            else:
                mine.append(w)
        seen.update(dict.fromkeys(mine))
        out[i] = raw, off
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeats(docs, small, monkeypatch):
    if small:  # many packs, slices and rounds
        monkeypatch.setattr(suffix, "PACK", 3000)
        monkeypatch.setattr(suffix, "SLICE", 512)
        monkeypatch.setattr(suffix, "GROUPS", 64)
        monkeypatch.setattr(suffix, "FAN", 4)
        monkeypatch.setattr(suffix, "HELD", 500)
        suffix._tables.clear()
    want = expected_repeats(50)
    got = suffix.dedup(docs, keep=["n", "t", "key"]).collect()
    suffix._tables.clear()
    assert len(got) == len(ROWS) and sum(o.sum() for _, o in want.values()) > 5000
    for r in got:
        raw, off = want[r.doc_id]
        mine = np.zeros(len(raw), bool)
        for s in r.spans:
            mine[s.start : s.end] = True
        assert r.n_bytes == len(raw) and (mine == off).all() and bytes(r.kept) == bytes(np.frombuffer(raw, np.uint8)[~off])
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False)) and (r.n, r.t, r.key) == (2, "t", "k")


def brute_repeats(rows, length=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw, mine = t.encode(), set()
        off = np.zeros(len(raw), bool)
        for j in range(len(raw) - length + 1):
            if raw[j : j + length] in seen:
                off[j : j + length] = True
            mine.add(raw[j : j + length])
        seen |= mine
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~off])
    return out


@pytest.mark.parametrize("pack", [suffix.PACK, 100])
def test_repeats_within_a_document(spark, pack, monkeypatch):
    """A passage that a document repeats in like surroundings, and a smaller document holds in others, goes everywhere."""
    monkeypatch.setattr(suffix, "PACK", pack)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    rows = []
    for n in range(50, 60):
        a, p, c = text(60), text(n), text(60)
        rows += [(100 * n, text(60) + p + text(60)), (100 * n + 1, (a + p + c) * 2), (100 * n + 2, text(30) + (p + c) * 3 + a)]
    got = {r.doc_id: bytes(r.kept) for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_repeats(rows)
    assert got == want and len(want[5501]) == len(rows[16][1]) - 110


def test_runs_that_differ_stay(spark):
    """Runs around one frequent line whose hashes agree in their upper 32 bits are not equal."""
    line = "before the line: the very frequent line that stands here"
    pairs = [("084488", "0058465", "119806", "0740870"), ("026151", "0089148", "303539", "0718132"), ("063347", "0643390", "345049", "0434835"), ("200850", "0526380", "248759", "0916614")]
    rows = [(2 * i + j, f"{p[2 * j]} {line} and {p[2 * j + 1]} after") for i, p in enumerate(pairs) for j in (0, 1)]
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        got = {r.doc_id: bytes(r.kept) for r in suffix.dedup(spark.createDataFrame([a, b], "doc_id long, text string")).collect()}
        assert got == brute_repeats([a, b])


@pytest.mark.parametrize("pack", [suffix.PACK, 400])
def test_one_line_between_others(spark, pack, monkeypatch):
    """A line of 60 bytes between ever different neighbours, some of which come again."""
    monkeypatch.setattr(suffix, "PACK", pack)
    rng = random.Random(14)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    line, sides = text(60), [text(40) for _ in range(30)]
    rows = [(i, rng.choice(sides) + line + rng.choice(sides) + (text(70) if i % 3 else line)) for i in range(120)]
    got = {r.doc_id: bytes(r.kept) for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_repeats(rows)


def test_refined_buckets(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[1000:1200] = raw[:200]
    for length in (50, 16, 33):
        at = np.concatenate([np.arange(0, 700), np.arange(950, 1100), [1500, 2800]])
        strings = [raw[i : i + length].tobytes() for i in at]
        for size in (1 << 18, 64):
            monkeypatch.setattr(suffix, "SLICE", size)
            got = list(zip(*suffix.buckets(raw, at, length), strict=True))
            assert len(set(zip(strings, got, strict=True))) == len(set(strings)) == len(set(got)) < len(at)


def test_repeats_edges(empty, nulls):
    assert suffix.dedup(empty).count() == 0
    assert sorted(r.n_bytes for r in suffix.dedup(nulls, as_text=True).collect()) == [0, 0, 0, 14, 14]


# mixing


def filled(sizes, budget, weights, cap):
    total, open_ = budget * sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(open_)}
    got = {}
    while open_:
        share = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= cap * sizes[s]]
        if not full:
            return got | share
        for s in full:
            got[s] = cap * sizes[s]
            total -= got[s]
            open_.remove(s)
    return got


def test_mix(docs):
    got = mix.plan(docs).collect()
    sizes = collections.Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    want = filled(sizes, 1.5, (3, 1, 2), 2)
    taken = collections.Counter()
    for r in got:
        assert r.size == len(words(TEXT[r.key])) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.copies * r.size
    for s in sizes:
        largest = max(len(words(r[1])) for r in ROWS if r[3] == s)
        assert abs(taken[s] - want[s]) <= largest
    again = {r.key: r.copies for r in mix.plan(docs.repartition(2)).collect()}
    assert again == {r.key: r.copies for r in got}
    rows = mix.mix(docs)
    assert rows.columns == docs.columns
    assert collections.Counter(r.doc_id for r in rows.collect()) == collections.Counter({k: n for k, n in again.items() if n})


def fair_queue(rows, budget, weights, cap, seed, ties):
    """The same queue in plain Python: copies by (key, source, text)."""
    units = collections.Counter(rows)
    size = {u: len(words(u[2])) * n for u, n in units.items()}
    sizes = collections.Counter()
    for u, n in size.items():
        sizes[u[1]] += n
    target = filled(sizes, budget, weights, cap)
    served = []
    for s in sizes:
        sofar = 0
        for u in sorted((u for u in units if u[1] == s), key=lambda u: ties[u][::-1]):
            sofar += size[u]
            if size[u] and target[s] > 0:
                served += [((sofar + e * sizes[s]) / target[s], ties[u][0], e, u) for e in range(cap)]
    left, copies = sum(target.values()), collections.Counter()
    for _, _, _, u in sorted(served, key=lambda x: x[:3]):
        if size[u] > left:
            break
        left -= size[u]
        copies[u] += 1
    return copies


def test_fair_queue(spark):
    """Taken rows against a plain queue, with repeated rows and a source of one document."""
    rng = random.Random(13)
    rows = [(i % 400, rng.choice([None, "a", "b", "b", "c"]), "w " * rng.choice([0, 1, 2, 5, 30, 80])) for i in range(500)]
    rows += [(1000, "d", "one two three")] + [(1001, "a", "same row here")] * 6 + [(1002, "e", None), (None, "b", "x y"), (None, None, None)]
    df = spark.createDataFrame([(k, t, s, 1, 2) for k, s, t in rows], "doc_id long, text string, source string, _copies int, tie int").repartition(3)
    ties = {(r.doc_id, r.source, r.text): (r.t, r.u) for r in df.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("t"), common.unit(F.xxhash64("doc_id", "text"), F.lit(1)).alias("u")).collect()}
    want = fair_queue(rows, 1.5, (3, 1, 2), 2, 1, ties)
    got = collections.Counter()
    mixed = mix.mix(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[(r.doc_id, r.source, r.text)] += 1
    assert got == collections.Counter({u: n * rows.count(u) for u, n in want.items()})
    plan = mix.plan(df).collect()
    assert len(plan) == len(rows) and sum(r.copies for r in plan) == sum(got.values())


def test_mix_edges(empty, nulls, spark):
    assert mix.plan(empty).count() == 0 and mix.mix(empty).count() == 0
    got = mix.plan(nulls).collect()
    assert len(got) == 5 and sum(r.copies * r.size for r in got) in (6, 9)
    assert all(r.copies == 0 for r in mix.plan(nulls.where("text is null")).collect())


# shards


def check_shards(rows, shards):
    places = collections.defaultdict(list)
    sizes = collections.Counter()
    for r in rows:
        places[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(0 <= s < shards for s in places)
    return sizes


def test_shards(docs, spark):
    got = shard.shard(docs.where("length(text) < 50000 or text is null"), 4).collect()
    sizes = check_shards(got, 4)
    for r in got:
        t = TEXT[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    # one text in two thirds of the rows, and one row repeated
    many = spark.createDataFrame([(i if i < 2000 else 5, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    sizes = check_shards(shard.shard(many).collect(), 16)
    assert max(sizes.values()) - min(sizes.values()) <= 24


def test_overfull_ranges(docs, monkeypatch):
    monkeypatch.setattr(shard, "OVERFULL", 0.01)
    monkeypatch.setattr(shard, "RANGES", 4)
    check_shards(shard.shard(docs, 3).collect(), 3)


def test_shards_edges(empty, nulls):
    assert shard.shard(empty).count() == 0
    check_shards(shard.shard(nulls).collect(), 16)


# language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op5_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held} == {True}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, logs = langid.learn(docs, "text", "lang", F.col("doc_id"))
    some = {r.lang: r.text for r in docs.where("n_chars between 1500 and 4000").orderBy("doc_id").collect()}
    both = spark.createDataFrame([(1, some["en"][:1000] + "\n" + some["de"][:500], "x", "y")], "doc_id long, text string, p string, s string")
    row = langid.identify(both, langs, logs, "text", ["doc_id", "p", "s"]).first()
    assert row.lang_pred == "en" and set(row.langs) == {"en", "de"} and 0.5 < row.score < 0.85 and (row.p, row.s) == ("x", "y")


def plain_language(text, logs):
    """EM over words and the nested choice, in plain Python: the chosen proportions; None without letters."""
    low, grams = (text or "").lower() + "\n", logs.shape[1] // 2
    mask = (1 << 64) - 1
    code = [ord(c) if c.isalpha() else 0 for c in low]
    like, word = [], None
    for i, c in enumerate(code):
        if not c:
            word = None
            continue
        before, after = code[i - 1] if i else 0, code[i + 1] if i + 1 < len(code) else 0
        two = (before * 0x9E3779B1 + c * 0x85EBCA77) * 0xC2B2AE3D27D4EB4F & mask
        three = (before * 0x9E3779B1 + c * 0x85EBCA77 + after * 0x27D4EB2F + 1) * 0xC2B2AE3D27D4EB4F & mask
        step = np.array([g[(two >> 40) % grams] + g[(three >> 40) % grams + grams] for g in logs], float)
        if word is None:
            word = len(like)
            like.append(step)
        else:
            like[word] = like[word] + step
    if not like:
        return None
    e = [np.maximum(np.exp(x - x.max()), langid.FLOOR) for x in like]

    def em(allowed):
        theta = allowed / allowed.sum()
        for _ in range(langid.ROUNDS):
            theta = sum(x * theta / (x * theta).sum() for x in e) / len(e)
            theta = np.maximum(theta, 1e-12) * allowed
        return theta, sum(np.log((x * theta).sum()) for x in e)

    order = np.argsort(-em(np.ones(len(logs)))[0], kind="stable")
    best, score = np.eye(len(logs))[order[0]], None
    score = sum(np.log(x[order[0]]) for x in e)
    for k in range(2, len(logs) + 1):
        theta, now = em(np.isin(np.arange(len(logs)), order[:k]).astype(float))
        now -= (k - 1) * (langid.PRICE + np.log(len(e)) / 2)
        if now <= score:
            break
        best, score = theta, now
    return best


def test_language_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, logs = langid.learn(docs, "text", "lang", F.col("doc_id"))
    rows = docs.where("n_chars < 900").orderBy("doc_id").limit(60).collect()
    some = [r.text for r in rows] + [a.text + " " + b.text for a, b in zip(rows, rows[1:], strict=False)][:40] + [None, "", "123", "é"]
    got = langid.infer(some, logs)
    for t, g in zip(some, got, strict=True):
        want = plain_language(t, logs)
        assert (g is None) == (want is None) and (g is None or np.allclose(g, want, atol=1e-4)), t
    assert sum(g is not None and (g > 0).sum() > 1 for g in got) > 5


def test_language_of_repeated_rows(docs, spark):
    """Rows repeat, a null stands beside a very long text, and each is judged apart."""
    langs, logs = langid.learn(docs, "text", "lang", F.col("doc_id"))
    long = " ".join(t for t in TEXT.values() if t) * 3
    df = spark.createDataFrame([(1, None), (2, long), (3, None), (2, long), (4, "one word"), (4, "one word")], "doc_id long, text string").coalesce(1)
    got = collections.defaultdict(set)
    for r in langid.identify(df, langs, logs, "text", ["doc_id"]).collect():
        got[r.doc_id].add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in got.values()) and got[1] == got[3] == {("und", 0.0)}


def test_language_edges(docs, empty, nulls):
    langs, logs = langid.learn(docs, "text", "lang", F.col("doc_id"))
    assert langs == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(docs, langs, logs, "text", ["doc_id"]).collect()}
    assert len(got) == len(ROWS)
    for i, t in TEXT.items():
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert langid.identify(empty, langs, logs, "text", ["doc_id"]).count() == 0
    none, table = langid.learn(empty, "text", "lang", F.col("doc_id"))
    assert none == [] and {r.lang_pred for r in langid.identify(nulls, none, table, "text", ["doc_id"]).collect()} == {"und"}
    assert langid.identify(nulls, langs, logs, "text", ["doc_id", "text"]).count() == 5


# quality


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    got = queries.op7_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in got} == {0}
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_quality_edges(docs, empty, nulls, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, None), (None, 1), (4, 1), (999, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels, "text", "doc_id", "quality", F.lit(True))
    got = quality.rate(docs, model, "text", ["doc_id", "t", "n"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.rate(empty, model, "text", ["doc_id"]).count() == 0 and quality.rate(nulls, model, "text", ["doc_id"]).count() == 5
    assert quality.learn(docs, labels.where("false"), "text", "doc_id", "quality", F.lit(True)) is None
    assert {r.score for r in quality.rate(nulls, None, "text", ["doc_id"]).collect()} == {0.5}


def test_repeated_rows_score_alike(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    twice = docs.union(docs)
    model = quality.learn(twice, labels, "text", "doc_id", "quality", F.lit(True))
    assert all((model[k] == v).all() for k, v in quality.learn(docs, labels, "text", "doc_id", "quality", F.lit(True)).items())
    got = collections.defaultdict(set)
    for r in quality.rate(twice, model, "text", ["doc_id"]).collect():
        got[r.doc_id].add(r.score)
    assert all(len(x) == 1 for x in got.values())


def plain_score(p, text):
    """The forward pass in plain Python, from words."""
    w = words(text)
    parts = [w[i : i + quality.PASSAGE] for i in range(0, len(w), quality.PASSAGE)] or [[]]
    every = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    h, s = [], []
    for i, part in enumerate(parts):
        x = np.zeros(quality.WIDTH)
        e = np.zeros(quality.HIDDEN)
        if part:
            begin = every[i * quality.PASSAGE][0]
            end = every[(i + 1) * quality.PASSAGE][0] if (i + 1) * quality.PASSAGE < len(every) else len(text)
            chars, k = text[begin:end], len(quality.SYMBOLS)
            letters = [c for c in chars if c.isalpha()]
            low = [x_.translate(str.maketrans({chr(j): chr(j + 32) for j in range(65, 91)})) for x_ in part]
            x[:k] = [chars.count(m) / len(part) for m in quality.SYMBOLS]
            x[k] = len(letters) / len(chars)
            x[k + 1] = sum("A" <= c <= "Z" for c in letters) / max(1, len(letters))
            x[k + 2] = sum("0" <= c <= "9" for c in chars) / len(chars)
            x[k + 3] = sum(ord(c) >= 128 for c in chars) / len(chars)
            x[k + 4] = chars.count("\n") / len(part)
            x[k + 5] = np.mean([np.log1p(len(x_)) for x_ in part])
            x[k + 6] = np.mean([len(x_) <= 3 for x_ in part])
            x[k + 7] = sum(a == b for a, b in zip(low, low[1:], strict=False)) / len(part)
            x[k + 8] = (len(low) - len(set(low))) / len(part)
            x[k + 9] = np.log1p(len(part)) / 5
            x[k + 10] = 1
            mask = (1 << 64) - 1
            tokens = []
            for word in low:
                each = [(ord(c) ^ j << 21) * int(quality.ODD) & mask for j, c in enumerate(word)]
                value = sum((v ^ v >> 31) * int(quality.ODD) for v in each) & mask
                for salt, v in ((1, value), (2, gram(word)), (3, gram(word[::-1]))):
                    v = (v ^ (v >> 29) ^ (salt << 40)) * int(quality.ODD) & mask
                    tokens.append(((v ^ (v >> 32)) * int(quality.ODD) & mask) >> (64 - quality.BUCKETS.bit_length() + 1))
            e = np.mean([p["e"][t] for t in tokens], axis=0)
        one = np.tanh((x.astype(np.float32) - p["mean"]) / p["std"] @ p["w"] + p["b"] + e)
        h.append(one)
        s.append(float((np.tanh(one @ p["v"]) / (1 + np.exp(-(one @ p["u"])))) @ p["a"]))
    a = np.exp(np.array(s) - max(s))
    return 1 / (1 + np.exp(-((a / a.sum()) @ np.array(h) @ p["c"] + p["d"][0])))


def gram(word):
    out = 0
    for j in range(3):
        out = out * (1 << 21) + (ord(word[j]) + 1 if j < len(word) else 0)
    return out


def test_scores_by_brute_force(monkeypatch):
    """Against plain Python, with texts of any number of passages, cut in layouts and in segments or not."""
    rng = np.random.default_rng(3)
    some = [t for t in TEXT.values() if t is None or len(t) < 5000] + ["Wörter UND Zahlen 12 34, (so) so so!\n" * 90]
    labels = rng.integers(0, 2, len(some)).astype(float)
    p = quality.train(quality.bags(some), labels)
    want = [plain_score(p, t) for t in some]
    assert np.allclose(quality.score(p, some), want, atol=1e-5)
    long = " ".join(t for t in some if t)
    whole = quality.score(p, [None, long, "x"])
    from tamis.llm import letters

    monkeypatch.setattr(quality, "CHUNK", 2000)
    monkeypatch.setattr(letters, "CHUNK", 2000)
    assert np.allclose(quality.score(p, [None, long, "x"]), whole, atol=1e-6) and len(quality._segments([long])[0]) > 5
    assert np.allclose(whole, [plain_score(p, t) for t in (None, long, "x")], atol=1e-5)


def test_gradient(monkeypatch):
    """The gradient against differences of the loss."""
    monkeypatch.setattr(quality, "BUCKETS", 64)
    rng = np.random.default_rng(0)
    some = quality.bags([ROWS[i][1] for i in range(12)] + [None])
    some = [(x, t % 64, s) for x, t, s in some]
    labels = rng.integers(0, 2, len(some)).astype(float)
    p = {"mean": np.zeros(quality.WIDTH), "std": np.ones(quality.WIDTH)} | {k: rng.normal(0, 0.3, s) for k, s in {"b": (quality.HIDDEN,), "d": (1,), "e": (64, quality.HIDDEN), "w": (quality.WIDTH, quality.HIDDEN), "v": (quality.HIDDEN, quality.ATTENTION), "u": (quality.HIDDEN, quality.ATTENTION), "a": (quality.ATTENTION,), "c": (quality.HIDDEN,)}.items()}
    grad, _ = quality.gradient(p, some, labels)
    for k, g in grad.items():
        for i in rng.integers(0, g.size, 4):
            at = np.unravel_index(i, g.shape)
            loss = []
            for step in (1e-5, -1e-5):
                q = {n: x.copy() for n, x in p.items()}
                q[k][at] += step
                loss.append(quality.gradient(q, some, labels)[1])
            assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-6)


# licences


def test_licences(spark):
    mit, gpl, apache = "Some words.\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "x " * 50 + "\nLicensed under the Apache License, Version 2.0.\ny"
    rows = [
        (1, mit, "a/LICENSE"), (2, "nothing", "a/x.txt"), (3, "nothing", "a/b/c/x.txt"), (4, gpl, "a/b/COPYING.txt"), (5, apache, "a/b/y.txt"), (6, "no license here at all, none", "z/x.txt"),
        (7, None, "a/b/z.txt"), (8, "", None), (9, mit, None), (10, mit, "LICENSE-2"), (11, "t", "top.txt"), (12, "t", "z/q.txt"), (13, "unrelated license text", "a/b/c/LICENSE"), (6, "no license here at all, none", "z/x.txt"),
        (14, "word " * 20_000 + "license " * 20_000, "y/long.txt"), (15, gpl, "a/NOTICE"),
    ]
    got = collections.defaultdict(list)
    for r in license.scan(spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, path string, own string, dir int")).collect():
        got[r.doc_id].append((r.license, r.basis, r.license_path))
    assert got[1] == [("MIT", "notice", "a/LICENSE")] and got[2] == [("MIT", "inherited", "a/LICENSE")] and got[3] == [("GPL-3.0", "inherited", "a/b/COPYING.txt")]
    assert got[5] == [("Apache-2.0", "notice", "a/b/y.txt")] and got[7] == [("GPL-3.0", "inherited", "a/b/COPYING.txt")] and got[6] == [("MIT", "inherited", "LICENSE-2")] * 2
    assert got[8] == [(None, "none", None)] and got[9] == [("MIT", "notice", None)] and got[11][0][1] == got[12][0][1] == "inherited" and got[13][0][1] == "inherited" and got[14][0][1] == "inherited"


def test_licence_scores(spark):
    """Against the same measure in plain Python."""
    idf, other, vectors = license.weights(license.TEMPLATES)
    texts = ["Licensed under CC BY-NC 4.0", "released under mit or apache license version 2.0", "license", "SPDX-License-Identifier: MIT", "the license the license the MIT", "Licensed under the GNU Lesser General Public License, version 3"]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id int, text string, path string")).collect()}
    for i, t in enumerate(texts):
        c = collections.Counter(license.words(t))
        size = sum((k * idf.get(w, other)) ** 2 for w, k in c.items()) ** 0.5
        best = max((round(sum(k * idf[w] * v.get(w, 0) for w, k in c.items() if w in v) / size, 9) for _, v in vectors))
        assert (got[i].score == pytest.approx(best)) if best >= license.THRESHOLD else (got[i].basis == "none")


def test_licence_texts(spark):
    """Headers and bodies over several lines, wrapped anew and marked as comments; titles; licence files as a whole."""
    import textwrap

    rows = [(name, "int x;\n" + "\n".join(f" * {line}" for line in textwrap.wrap(t, 50)) + "\nother code", None) for name, _, t in license.headers()]
    rows += [("MIT", "MIT License\n\nCopyright (c) 2020 A", None), ("GPL-3.0", "   GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", None), ("none", "I like the MIT license of this, and free software is good.", None), ("none", "Redistribution and use of water.", None)]
    rows += [(name, "Copyright 2021 Somebody\n\n" + texts[0].replace("\n\n", "\n"), f"p{name}/LICENSE") for name, texts in license.licence_texts().items()]
    got = license.scan(spark.createDataFrame([(i, t, p) for i, (_, t, p) in enumerate(rows)], "doc_id int, text string, path string")).collect()
    assert [(r.license or "none") for r in sorted(got, key=lambda r: r.doc_id)] == [name for name, _, _ in rows]
    assert len(license.licence_texts()) == 11 and all(re.search(license.MENTION, t) for texts in license.licence_texts().values() for t in texts)


def test_licences_edges(empty, nulls):
    assert license.scan(queries.licence_paths(empty)).count() == 0
    assert license.scan(queries.licence_paths(nulls)).count() == 5


# tokens


@pytest.fixture(scope="module")
def public():
    return Public.from_file(queries.vocabulary())


def test_bpe(docs, public, spark):
    more = ["<|endoftext|>a<|startoftext|>", "ΣΑΣ İ ǅ ﬁ ０１²½ \x1c\x85   ​ é don't I'LL 's'", "\U0001f600 漢字", "'" * 50 + "s", "ABCdef" * 300, "\x00\x01", "aaaa " * 2000]
    every = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = TEXT | {1000 + i: t for i, t in enumerate(more)}
    got = bpe.encode(every, queries.vocabulary()).collect()
    assert len(got) == len(texts)
    for r in got:
        want = public.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(np.frombuffer(r.ids, "<u4")) == want and r.n_tokens == len(want)
        assert r.decoded == public.decode(want, skip_special_tokens=False)


def test_bpe_of_repeated_rows(docs):
    some = docs.where("length(text) < 3000 or text is null").limit(40)
    got = collections.defaultdict(set)
    for r in bpe.encode(some.union(some), queries.vocabulary()).collect():
        got[r.doc_id].add((bytes(r.ids), r.decoded))
    assert len(got) == 40 and all(len(x) == 1 for x in got.values())


def test_merges_are_leftmost_lowest():
    rng = random.Random(2)
    pairs = {a << 32 | b: (rng.randint(0, 40) * 100 + a * 6 + b, rng.randint(0, 5)) for a in range(6) for b in range(6) if rng.random() < 0.6}
    for _ in range(300):
        ids = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        plain = list(ids)
        while found := [(pairs[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False)) if a << 32 | b in pairs]:
            _, i = min(found)
            plain[i : i + 2] = [pairs[plain[i] << 32 | plain[i + 1]][1]]
        assert bpe.merge(ids, pairs) == plain


def test_bpe_small_cache(docs, public, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    t = bpe.Tokenizer(open(queries.vocabulary(), encoding="utf-8").read())
    for text in ("one two three four five one two", "one six seven", "two one"):
        assert list(np.frombuffer(t.encode(text)[0], "<u4")) == public.encode(text, add_special_tokens=False).ids


def test_merges_together():
    """Sequences merged at once are those merged one at a time, rows that end sooner or hold nothing among them."""
    rng = random.Random(4)
    pairs = {a << 32 | b: (rng.randint(0, 40) * 100 + a * 6 + b, rng.randint(0, 5)) for a in range(6) for b in range(6) if rng.random() < 0.6}
    for width in (2, 4, 16, 64):
        rows = [[rng.randint(0, 5) for _ in range(rng.randint(0, width))] for _ in range(200)]
        got = bpe.Pairs(pairs).merge(np.array([r + [-1] * (width - len(r)) for r in rows]))
        assert [[x for x in r if x >= 0] for r in got.tolist()] == [bpe.merge(r, pairs) for r in rows]


def test_bpe_new_words_in_less_time_than_their_merges():
    """Most words of a large table are met once: to merge them one at a time, 40 microseconds each, was most of the pipeline's
    last stage."""
    t = bpe.Tokenizer(open(queries.vocabulary(), encoding="utf-8").read())
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdluetaoin", k=10)) for _ in range(20_000)]
    rows = [[t.vocab[x] for x in w[:-1]] + [t.vocab[w[-1] + t.end]] for w in words]
    began = time.process_time()
    want = [bpe.merge(r, t.pairs) for r in rows]
    alone = time.process_time() - began
    text = " ".join(words)
    began = time.process_time()
    got = t.encode(text)[0]
    assert time.process_time() - began < 0.7 * alone
    assert list(np.frombuffer(got, "<u4")) == [i for r in want for i in r]


def test_bpe_copies_once():
    """Equal texts that come together, such as the copies that a mixture takes, are encoded once."""
    t = bpe.Tokenizer(open(queries.vocabulary(), encoding="utf-8").read())
    seen, normal = [], t.normal
    t.normal = lambda text: normal(seen.append(text) or text)
    got = t.encode_all(["one two", "three", "one two", "", "three", "one two"])
    assert seen.count("one two") == seen.count("three") == 1
    assert got == [t.encode(x) for x in ("one two", "three", "one two", "", "three", "one two")]


def test_bpe_words(public):
    """Words without white space, of any length, with separators that are none, and like a special token in capitals; also when
    little is kept or merged together."""
    t = bpe.Tokenizer(open(queries.vocabulary(), encoding="utf-8").read())
    texts = ["x\x1cy\x1d z\x1f", "<|ENDOFTEXT|> <|endoftext|>a", "don't''s " * 40, "don't''s" * 40, "漢" * 64 + " " + "漢" * 65, "q" * 64 + "1" + "q" * 65, "é" * 32 + "\u2003" + "é" * 33, "ab" * 3000 + "'s", " \x85 ", "", "a b"]
    for got, text in zip(t.encode_all(texts), texts, strict=True):
        want = public.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(got[0], "<u4")) == want and got[1] == public.decode(want, skip_special_tokens=False)
    assert max(len(w) for w in t.ids if isinstance(w, str)) <= bpe.LONG


def test_bpe_edges(empty, nulls):
    assert bpe.encode(empty, queries.vocabulary(), keep=["doc_id", "n"]).count() == 0
    got = bpe.encode(nulls, queries.vocabulary(), keep=["doc_id", "n"]).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 3, 3] and all(r.ids == b"" and r.decoded == "" for r in got if not r.n_tokens)


# what they share


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(1, 90)] + [(3, 3)]
    nodes = {n for a, b in links for n in (a, b) if a != b}
    want = components([x for x in links if x[0] != x[1]], nodes)
    got = common.components(spark.createDataFrame(links, "a long, b long"))
    assert dict(map(tuple, got.collect())) == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    values = ["b", None, "a", "c", "a", None]
    got = common.ranked(spark.createDataFrame([(v,) for v in values], "v string"), [F.col("v").asc_nulls_last()], "nth").orderBy("nth").collect()
    assert [(r.v, r.nth) for r in got] == [("a", 0), ("a", 1), ("b", 2), ("c", 3), (None, 4), (None, 5)]


def test_running(spark):
    rows = [(i * 37 % 101, i % 7) for i in range(101)]
    got = {r.k: r.s for r in common.running(spark.createDataFrame(rows, "k long, n long"), [F.col("k")], "n", "s").collect()}
    assert got == {k: sum(n for j, n in rows if j <= k) for k, _ in rows}


def test_word_count(docs):
    for r in docs.select("doc_id", common.word_count(F.col("text")).alias("c")).collect():
        assert r.c == len(words(TEXT[r.doc_id]))


def test_digests(docs, spark):
    """op10's digests are those of the ids and the decoded text."""
    row = queries.op10_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    ids, decoded = bpe.Tokenizer(open(queries.vocabulary(), encoding="utf-8").read()).encode(text)
    assert (row.ids_sha256, row.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

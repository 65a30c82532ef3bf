"""The pipeline's stages on a small table, each against brute force on what the one before kept."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tamis.llm import bpe, queries
from tamis.llm.common import stage

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, "123 --- 456", "en", "a", 11), (9004, "word", "en", "a", 4)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(1))
    out = [docs]
    for name, f in pipeline.STAGES:
        out.append(stage(f(spark, out[-1], DATA), name))
    return out


def test_columns(steps):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language", "near_copies", "repeats", "mixture", "tokens"]
    assert all(d.columns == pipeline.COLUMNS for d in steps[1:-1])


def test_language(steps):
    gone = {r.doc_id for r in steps[0].collect()} - {r.doc_id for r in steps[1].collect()}
    assert gone == {9001, 9002, 9003}


def test_near_copies(steps):
    def shingles(t):
        low = t.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})).replace("\n", " ")
        w = [x for x in low.split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    rows = {r.doc_id: shingles(r.text) for r in steps[1].collect()}
    root = {i: i for i in rows}
    for a in rows:
        for b in rows:
            if a < b and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                x, y = sorted((_top(root, a), _top(root, b)))
                root[y] = x
    kept = [r.doc_id for r in steps[2].collect()]
    assert sorted(kept) == sorted(i for i in rows if root[i] == i)


def test_near_copies_without_ids(spark):
    """Unlike texts under a null or shared id all stay; equal rows and near copies go."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "one two three four five six"), (None, "quite another text of some words"), (None, "quite another text of some words"), (7, "seven has a first text here"), (7, "and seven has a second one too"), (9, long), (None, long + " more"), (None, "x " + long)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_copies(spark, docs, DATA)
    assert got.columns == pipeline.COLUMNS
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([rows[0], rows[1], rows[3], rows[4], rows[5]])


def _top(root, x):
    while root[x] != x:
        x = root[x]
    return x


def test_repeats(steps):
    seen, want = set(), {}
    for r in sorted(steps[2].collect(), key=lambda r: r.doc_id):
        raw = r.text.encode()
        off, mine = set(), []
        for j in range(len(raw) - 49):
            w = raw[j : j + 50]
            off.update(range(j, j + 50)) if w in seen else mine.append(w)
        seen.update(mine)
        left = bytes(b for k, b in enumerate(raw) if k not in off).decode("utf-8", "ignore")
        if not off or left.strip():
            want[r.doc_id] = left
    got = {r.doc_id: r.text for r in steps[3].collect()}
    assert got == want and all(r.n_chars == len(r.text) for r in steps[3].collect())


def test_mixture(steps):
    before, after = steps[3], steps[4]
    assert after.join(before, ["doc_id", "text"], "left_anti").count() == 0
    counts = collections.Counter(r.doc_id for r in after.collect())
    assert max(counts.values()) <= 2
    total = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert total(after) == pytest.approx(1.5 * total(before), rel=0.2)


def test_tokens(steps):
    t = bpe.Tokenizer(open(queries.vocabulary(), encoding="utf-8").read())
    want = collections.Counter((r.doc_id, t.encode(r.text)[0]) for r in steps[4].collect())
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in steps[5].collect()) == want


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, DATA)
        assert docs.count() == 0


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0 and pipeline.ORACLE_SQL is None

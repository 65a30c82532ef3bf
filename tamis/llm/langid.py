"""Language ID by mixture inference: each document is a mixture of languages that emit its words.

A language is a smoothed distribution over hashed letter bigrams and trigrams. A word's likelihood under a language is
the product over its letters. Expectation-maximisation gives the document's language proportions; languages are then
taken in order of proportion while the penalised likelihood of the mixture rises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, tidy, tune, unit
from .letters import is_letter, layouts, runs

GRAMS = 1 << 15
#: Documents that the n-gram counts are learned from, drawn evenly by a hash of their key; whole texts are counted.
TRAIN_ROWS = 20_000
ROUNDS = 12
#: A language joins a document's set if log-likelihood rises by more than PRICE + log(words) / 2.
PRICE = 4.0
#: Likelihood of a word under a language, relative to the best language, is at least this.
FLOOR = 1e-9
NONE = "und"


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bigram and trigram of each letter of lower-cased text, and where words start in them and in codes."""
    letter = is_letter(codes)
    c = np.where(letter, codes, 0).astype(np.uint64)
    before, after = np.roll(c, 1), np.roll(c, -1)
    at = np.flatnonzero(letter)
    two = (before[at] * np.uint64(0x9E3779B1) + c[at] * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (before[at] * np.uint64(0x9E3779B1) + c[at] * np.uint64(0x85EBCA77) + after[at] * np.uint64(0x27D4EB2F) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    first, _ = runs(letter)
    half = np.uint64(GRAMS // 2)
    return (two >> np.uint64(40)) % half, (three >> np.uint64(40)) % half + half, np.searchsorted(at, first), first


def _em(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, of: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document when it mixes the languages allowed."""
    theta = allowed / allowed.sum(1, keepdims=True)
    for k in range(ROUNDS + 1):
        r = e * theta[of]
        total = r.sum(1)
        if k == ROUNDS:
            return theta, np.add.reduceat(np.log(total), starts)
        theta = np.add.reduceat(r / total[:, None], starts) / sizes[:, None]
        theta = np.maximum(theta, 1e-12) * allowed


def infer(part: list[str | None], logs: np.ndarray) -> list[np.ndarray | None]:
    """For each text its language proportions over the chosen set, None without letters. logs: languages x grams."""
    out: list[np.ndarray | None] = []
    for which, codes, starts in layouts([(t or "").lower() for t in part]):
        two, three, at, first = _words(codes)
        found: list[np.ndarray | None] = [None] * len(which)
        out.extend(found)
        if not len(at):
            continue
        like = np.stack([np.add.reduceat(g[two] + g[three], at) for g in logs], 1)
        e = np.maximum(np.exp(like - like.max(1, keepdims=True)), FLOOR)
        doc = np.searchsorted(starts, first, "right") - 1
        docs, head = np.unique(doc, return_index=True)
        sizes = np.diff(np.append(head, len(doc)))
        of = np.repeat(np.arange(len(docs)), sizes)
        full, _ = _em(e, head, sizes, of, np.ones((len(docs), len(logs))))
        order = np.argsort(-full, 1, kind="stable")
        best = np.zeros_like(full)
        best[np.arange(len(docs)), order[:, 0]] = 1
        rank = np.argsort(order, 1, kind="stable")
        score = np.add.reduceat(np.log((e * best[of]).sum(1)), head)
        left = np.arange(len(docs))
        for k in range(2, len(logs) + 1):
            some = np.isin(of, left)
            s = sizes[left]
            h = np.concatenate([[0], np.cumsum(s)[:-1]])
            theta, now = _em(e[some], h, s, np.repeat(np.arange(len(left)), s), (rank[left] < k).astype(float))
            now = now - (k - 1) * (PRICE + np.log(s) / 2)
            better = now > score[left]
            best[left[better]], score[left[better]] = theta[better], now[better]
            left = left[better]
            if not len(left):
                break
        for d, t in zip(docs, best, strict=True):
            out[which[0] + d] = t
    return out


def learn(df: DataFrame, text: str, lang: str, key: Column, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages by code point and the log-probability of each hashed gram, from labelled rows.

    About `rows` rows are read, drawn by a hash of key; the counts that come to the driver are at most languages x GRAMS.
    """
    tune(df.sparkSession)
    some = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), unit(key, F.lit(11)).alias("u"))
    share = min(1.0, rows / max(1, some.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, column in texts(batches, 0):
            by: dict[str, list[str]] = {}
            for t, l in zip(column, batch.column(1).to_pylist(), strict=True):
                by.setdefault(l, []).append(t.lower())
            for l, part in by.items():
                s = sums.setdefault(l, np.zeros(GRAMS))
                for _, codes, _ in layouts(part):
                    two, three, _, _ = _words(codes)
                    s += np.bincount(two, minlength=GRAMS) + np.bincount(three, minlength=GRAMS)
        for l, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.float64())], names=["l", "g", "n"])

    counts = some.where(F.col("u") < share).select("t", "l").mapInArrow(tidy(count), "l string, g int, n double").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["l"].unique())
    table = np.full((len(langs), GRAMS), 0.5)
    for k, l in enumerate(langs):
        own = counts[counts["l"] == l]
        table[k, own["g"]] += own["n"]
    half = GRAMS // 2
    logs = np.concatenate([np.log(t / t.sum(1, keepdims=True)) for t in (table[:, :half], table[:, half:])], 1) if langs else table
    return langs, logs.astype(np.float32)


def identify(df: DataFrame, langs: list[str], logs: np.ndarray, text: str, keep: list[str]) -> DataFrame:
    """The columns keep with lang_pred, score (its proportion) and langs (the chosen set with proportions).

    A text that is null or has no letter, or any text if nothing was learned, gets `und`, score 0 and no set. Ties go to
    the smaller language. Rows are judged apart: repeated rows and extra columns change nothing.
    """
    tune(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(logs)
    types = dict(df.dtypes)
    at = keep.index(text) if text in keep else len(keep)
    rows = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [df[text].alias("t")]))
    schema = ", ".join([*(f"k{i} {types[c]}" for i, c in enumerate(keep)), "p string, s double, m map<string,double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in texts(batches, at):
            got = infer(column, model.value) if langs else [None] * len(column)
            top = [None if t is None else int(t.argmax()) for t in got]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(keep))),
                    pa.array([NONE if k is None else langs[k] for k in top], pa.string()),
                    pa.array([0.0 if k is None else min(1.0, float(t[k])) for t, k in zip(got, top, strict=True)], pa.float64()),
                    pa.array([[] if t is None else [(langs[k], float(t[k])) for k in np.flatnonzero(t > 0)] for t in got], pa.map_(pa.string(), pa.float64())),
                ],
                names=[*(f"k{i}" for i in range(len(keep))), "p", "s", "m"],
            )

    out = rows.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("p").alias("lang_pred"), F.col("s").alias("score"), F.col("m").alias("langs"))


def key_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n

"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A passage is PASSAGE words. It is encoded by learned embeddings of its hashed words and of the character trigrams that begin
and end them, and by learned weights of surface rates (marks, cases, digits, lengths, repeats). Gated attention weighs the
passages, and the weighted sum of their encodings is scored. Only documents have labels: embeddings, encoder, attention and
score are learned together from those. A document's passages may be any number: their weighted sum is taken as they come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, texts, tidy, tune, unit
from .letters import CHUNK, SPACES, is_letter, layouts, runs

#: Words of a passage.
PASSAGE = 64
#: The sample that the driver learns from: about so many labelled documents, drawn evenly by a hash of their key; so many
#: bytes of text in all; none longer than so many bytes.
TRAIN_ROWS, TRAIN_BYTES, LONGEST = 6000, 12 << 20, 1 << 20
#: Rows of the embedding table, size of an encoding, of attention; passes over the sample, rate, weight decay of embeddings.
BUCKETS, HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 1 << 14, 16, 8, 16, 0.02, 1e-4
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WIDTH = len(SYMBOLS) + 11
ODD = np.uint64(0x9E3779B97F4A7C15)
_ROOT = ("mean", "std")


def _segments(part: list[str | None]) -> tuple[list[str], list[int]]:
    """Texts, long ones cut between passages so that none is much longer than CHUNK, and the text that each is of."""
    out, of = [], []
    for i, t in enumerate(part):
        if not t or len(t) <= CHUNK:
            out.append(t or "")
            of.append(i)
            continue
        held, size = [], 0
        for m in re.finditer(rf"[{SPACE}]*(?:[^{SPACE}]+[{SPACE}]*){{1,{PASSAGE}}}", t):
            held.append(m.group())
            size += len(held[-1])
            if size > CHUNK // 2:
                out.append("".join(held))
                of.append(i)
                held, size = [], 0
        if held or i not in of[-1:]:
            out.append("".join(held))
            of.append(i)
    return out, of


def passages(part: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, rates, tokens, starts) of some passages at a time, in order: the text that each passage is of, an array of
    passages x WIDTH, hashed words and trigrams, and where each passage's begin. A text without words is one passage, of zeros."""
    kind = np.full(128, -1, np.int64)
    kind[[ord(x) for x in SYMBOLS]] = np.arange(len(SYMBOLS))
    segments, owner = _segments(part)
    owner = np.array(owner, np.int64)
    for which, codes, starts in layouts(segments):
        n = len(which)
        first, last = runs(~np.isin(codes, SPACES))
        doc = np.searchsorted(starts, first, "right") - 1
        words = np.bincount(doc, minlength=n)
        count = np.maximum(1, -(-words // PASSAGE))
        base = np.concatenate([[0], np.cumsum(count)])
        nth = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(words)])[doc]
        of_word = base[doc] + nth // PASSAGE
        total = int(base[-1])
        x, tokens = np.zeros((total, WIDTH)), np.empty(0, np.int64)
        if len(first):
            # characters from a word's first to the next word, or to the text's end
            size = np.minimum(np.append(first[1:], len(codes)), starts[doc + 1] - 1) - first
            of_char = np.repeat(of_word, size)
            c = codes[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            letter = is_letter(c)
            mark = np.where(c < 128, kind[np.where(c < 128, c, 0)], -1)
            at = mark >= 0
            k = len(SYMBOLS)
            x[:, :k] = np.bincount(of_char[at] * k + mark[at], minlength=total * k).reshape(total, k)
            chars = np.maximum(1, np.bincount(of_char, minlength=total))
            letters = np.bincount(of_char, letter, total)
            length = np.log1p(last - first)
            # a word's value: sum over its code points, A-Z as a-z, of a hash of code point and place
            low = codes + 32 * ((codes >= 65) & (codes <= 90)).astype(np.uint32)
            place = np.arange(len(codes)) - first[np.maximum(0, np.searchsorted(first, np.arange(len(codes)), "right") - 1)]
            with np.errstate(over="ignore"):
                each = (low.astype(np.uint64) ^ place.astype(np.uint64) << np.uint64(21)) * ODD
                value = np.add.reduceat((each ^ each >> np.uint64(31)) * ODD, np.stack([first, last], 1).ravel())[::2]
                begin, end = (_trigram(low, first, last, i) for i in (0, 1))
                tokens = np.stack([_bucket(value, 1), _bucket(begin, 2), _bucket(end, 3)], 1).ravel()
            same = np.zeros(len(value))
            same[1:] = (value[1:] == value[:-1]) & (of_word[1:] == of_word[:-1])
            pair = np.lexsort((value, of_word))
            again = np.zeros(len(value))
            again[pair[1:]] = (value[pair[1:]] == value[pair[:-1]]) & (of_word[pair[1:]] == of_word[pair[:-1]])
            w = np.maximum(1, np.bincount(of_word, minlength=total))
            x[:, :k] /= w[:, None]
            x[:, k] = letters / chars
            x[:, k + 1] = np.bincount(of_char, letter & (c >= 65) & (c <= 90), total) / np.maximum(1, letters)
            x[:, k + 2] = np.bincount(of_char, (c >= 48) & (c <= 57), total) / chars
            x[:, k + 3] = np.bincount(of_char, c >= 128, total) / chars
            x[:, k + 4] = np.bincount(of_char, c == 10, total) / w
            x[:, k + 5] = np.bincount(of_word, length, total) / w
            x[:, k + 6] = np.bincount(of_word, last - first <= 3, total) / w
            x[:, k + 7] = np.bincount(of_word, same, total) / w
            x[:, k + 8] = np.bincount(of_word, again, total) / w
            x[:, k + 9] = np.log1p(w) / 5
            x[:, k + 10] = 1
            x[np.bincount(of_word, minlength=total) == 0] = 0
        yield np.repeat(owner[which[0] : which[0] + n], count), x.astype(np.float32), tokens, np.searchsorted(of_word, np.arange(total + 1)) * 3


def _trigram(low: np.ndarray, first: np.ndarray, last: np.ndarray, end: int) -> np.ndarray:
    """The three characters that begin a word, or end it, as a number; a shorter word's are fewer."""
    out = np.zeros(len(first), np.uint64)
    for j in range(3):
        at = last - 1 - j if end else first + j
        inside = (at >= first) & (at < last)
        out = out * np.uint64(1 << 21) + np.where(inside, low[np.where(inside, at, 0)], 0).astype(np.uint64) + inside.astype(np.uint64)
    return out


def _bucket(value: np.ndarray, salt: int) -> np.ndarray:
    """Rows of the embedding table."""
    mixed = (value ^ (value >> np.uint64(29)) ^ np.uint64(salt << 40)) * ODD
    return ((mixed ^ (mixed >> np.uint64(32))) * ODD >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _mean(e: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean embedding of each passage's tokens; zero without any."""
    n = np.diff(starts)
    out = np.zeros((len(n), e.shape[1]), e.dtype)
    if len(tokens):
        some = n > 0
        out[some] = np.add.reduceat(e[tokens], starts[:-1][some]) / n[some, None]
    return out


def _encoded(p: dict[str, np.ndarray], x: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> tuple:
    """Encodings of passages, the two halves of their gate, and their unnormalised log attention."""
    h = np.tanh(((x - p["mean"]) / p["std"]) @ p["w"] + p["b"] + _mean(p["e"], tokens, starts))
    t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    return h, t, g, (t * g) @ p["a"]


def score(p: dict[str, np.ndarray], part: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text, to nine places, so that it doesn't depend on what other texts come with it.
    Weights are kept against the largest so far: passages may be any number."""
    top, weight, sums = np.full(len(part), -np.inf), np.zeros(len(part)), np.zeros((len(part), HIDDEN))
    for of, x, tokens, starts in passages(part):
        h, _, _, s = _encoded(p, x, tokens, starts)
        docs, head = np.unique(of, return_index=True)
        high = np.maximum(top[docs], np.maximum.reduceat(s, head))
        old, a = np.exp(top[docs] - high), np.exp(s - np.repeat(high, np.diff(np.append(head, len(of)))))
        weight[docs] = weight[docs] * old + np.add.reduceat(a, head)
        sums[docs] = sums[docs] * old[:, None] + np.add.reduceat(a[:, None] * h, head)
        top[docs] = high
    y = (sums / np.maximum(weight, 1e-300)[:, None]) @ p["c"] + p["d"]
    return np.round(1 / (1 + np.exp(-np.clip(y, -30, 30))), 9)


def gradient(p: dict[str, np.ndarray], bags: list[tuple], labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradient of the mean log loss of documents, and the loss. bags: (rates, tokens, starts) of each."""
    sizes = np.array([len(b[0]) for b in bags])
    at, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
    x, tokens = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    counts = np.concatenate([np.diff(b[2]) for b in bags])
    starts = np.concatenate([[0], np.cumsum(counts)])
    h, t, g, s = _encoded(p, x, tokens, starts)
    s = np.exp(s - np.maximum.reduceat(s, at)[of])
    a = s / np.add.reduceat(s, at)[of]
    z = np.add.reduceat(a[:, None] * h, at)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    dy = (y - labels) / len(bags)
    dz = dy[:, None] * p["c"]
    da = (h * dz[of]).sum(1)
    ds = a * (da - np.add.reduceat(a * da, at)[of])
    dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
    dh = (a[:, None] * dz[of] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
    each = np.repeat(dh / np.maximum(1, counts)[:, None], counts, axis=0)
    de = np.stack([np.bincount(tokens, each[:, j], BUCKETS) for j in range(HIDDEN)], 1) if len(tokens) else np.zeros_like(p["e"])
    n = (x - p["mean"]) / p["std"]
    loss = -float(np.mean(labels * np.log(y + 1e-12) + (1 - labels) * np.log(1 - y + 1e-12)))
    return {"w": n.T @ dh, "b": dh.sum(0), "e": de, "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ dy, "d": np.array([dy.sum()])}, loss


def train(bags: list[tuple], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Gradient descent (Adam) on the log loss of documents."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([b[0] for b in bags]).astype(float)
    p = {"mean": every.mean(0), "std": every.std(0) + 1e-3, "b": np.zeros(HIDDEN), "d": np.zeros(1), "e": np.zeros((BUCKETS, HIDDEN))}
    for name, shape in (("w", (WIDTH, HIDDEN)), ("v", (HIDDEN, ATTENTION)), ("u", (HIDDEN, ATTENTION)), ("a", (ATTENTION,)), ("c", (HIDDEN,))):
        p[name] = rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    names = [k for k in p if k not in _ROOT]
    m, q, step = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}, 0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 128)):
            grad, _ = gradient(p, [bags[i] for i in part], labels[part])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for k in names:
                g = grad[k] + (DECAY if k == "e" else 1e-5 if k in "wc" else 0) * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.99 * q[k] + 0.01 * g**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-8)
    return {k: (x.astype(np.float32) if k == "e" else x) for k, x in p.items()}


def bags(part: list[str | None]) -> list[tuple]:
    """(rates, tokens, starts) of each text."""
    out: list[list] = [[] for _ in part]
    for of, x, tokens, starts in passages(part):
        docs, head = np.unique(of, return_index=True)
        for d, i, j in zip(docs, head, np.append(head[1:], len(of)), strict=True):
            out[d].append((x[i:j], tokens[starts[i] : starts[j]], starts[i : j + 1] - starts[i]))
    return [b[0] if len(b) == 1 else (np.concatenate([y[0] for y in b]), np.concatenate([y[1] for y in b]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(y[2]) for y in b]))])) for b in out]


def learn(df: DataFrame, labels: DataFrame, text: str, key: str, label: str, allowed: Column, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray] | None:
    """Parameters from a bounded sample of labelled documents where `allowed` holds, drawn by a hash of the key: about `rows`
    of them and TRAIN_BYTES of text, none longer than LONGEST. None without labels. A key with several labels counts once,
    with their rounded mean, and so do rows that repeat a key and its text; null labels and null texts don't count."""
    tune(df.sparkSession)
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & allowed).groupBy(F.col(key).alias("k")).agg(F.round(F.avg(label)).cast("int").alias("y"))
    docs = df.where(F.col(text).isNotNull() & allowed & (F.octet_length(text) <= LONGEST)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    share = min(1.0, rows / max(1, marks.count()))
    drawn = unit(F.col("k"), F.lit(5))
    few = docs.where(drawn < share).join(marks.where(drawn < share), "k")
    size = few.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    share *= min(1.0, TRAIN_BYTES / max(1, size))
    got = few.where(drawn < share).distinct().toPandas()
    if not len(got):
        return None
    got = got.sort_values(["k", "t"], kind="stable")
    return train(bags(got["t"].tolist()), got["y"].to_numpy(float))


def rate(df: DataFrame, model: dict[str, np.ndarray] | None, text: str, keep: list[str]) -> DataFrame:
    """The columns keep with score, the probability of label 1. Null and empty texts are one empty passage; without a
    model every score is 0.5. Texts are scored whole, rows apart."""
    tune(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    types = dict(df.dtypes)
    rows = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in texts(batches, len(keep)):
            got = score(held.value, column) if held.value and column else np.full(len(column), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(got, pa.float64())], names=[*(f"k{i}" for i in range(len(keep))), "s"])

    out = rows.mapInArrow(tidy(run), ", ".join([*(f"k{i} {types[c]}" for i, c in enumerate(keep)), "s double"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("s").alias("score"))

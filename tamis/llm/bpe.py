"""BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tidy, tune

FREE = 1 << 62
#: Words whose ids a Python worker keeps, and as many from before that; those not met again go. It bounds memory and
#: changes no result.
CACHE = 250_000
#: Words of more characters are taken by pieces, and pieces of more are not kept.
LONG = 64
#: Characters of text whose new words are merged together (one longer text still comes alone).
TOGETHER = 1 << 19
#: Fixed value: the piece pattern of the word_bpe vocabularies, with white space as Unicode's White_Space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Characters that str.split takes as white space beyond White_Space.
SEPARATORS = regex.compile(r"[\x1C-\x1F]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the rest follow from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


def merge(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Apply the lowest-rank merge, leftmost first, until none is left. pairs: by left id << 32 | right id, the rank
    and the id of the merged symbol.

    Leaf i of the tree holds rank * width + i of the pair that starts at symbol i, so the root is the leftmost pair of
    the lowest rank. A merge changes three leaves, each updated along one path to the root, as far as minima change.
    """
    n = len(ids)
    if n < 2:
        return ids
    width = 1 << (n - 1).bit_length()
    tree = [FREE] * (2 * width)
    get, some = pairs.get, False
    for i in range(n - 1):
        if found := get(ids[i] << 32 | ids[i + 1]):
            tree[width + i] = found[0] * width + i
            some = True
    if not some:
        return ids
    for k in range(width - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < FREE:
        i = root % width
        j, h = after[i], before[i]
        k = after[i] = after[j]
        new = ids[i] = get(ids[i] << 32 | ids[j])[1]
        ids[j] = -1
        mine = prior = None
        if k < n:
            before[k] = i
            mine = get(new << 32 | ids[k])
        if h >= 0:
            prior = get(ids[h] << 32 | new)
        for leaf, found in ((j, None), (i, mine), (h, prior)):
            if leaf < 0:
                continue
            at = leaf + width
            low = found[0] * width + leaf if found else FREE
            while at and tree[at] != low:
                tree[at] = low
                if (other := tree[at ^ 1]) < low:
                    low = other
                at >>= 1
    return [x for x in ids if x >= 0]


class Pairs:
    """`merge` over many short sequences at once: each has its tree in a row, and a step merges the root's pair in all rows
    that have one left."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        ranked = sorted(pairs.items(), key=lambda p: p[1][0])
        keys = np.array([k for k, _ in ranked] + [FREE], np.int64)
        self.place = np.argsort(keys)
        self.keys = keys[self.place]
        self.joined = np.array([new for _, (_, new) in ranked] + [-1], np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """What the tree's leaf `at` holds for a pair; -1 stands for no symbol and makes none."""
        key = left << 32 | right
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.place[i] * width + at, FREE)

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """ids: a sequence in each row, padded by -1 to a power of two. The merged ones, -1 where a symbol is gone."""
        n, width = ids.shape
        bits = width.bit_length() - 1
        ids = np.hstack([ids, np.full((n, 1), -1)])
        tree = np.full((n, 2 * width), FREE)
        tree[:, width:] = self._leaf(ids[:, :-1], ids[:, 1:], np.arange(width), width)
        for k in (1 << b for b in range(bits - 1, -1, -1)):
            np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
        after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        symbol, low, after, before = ids.ravel(), tree.ravel(), after.ravel(), before.ravel()  # views: a row's places follow its first
        row = np.flatnonzero(tree[:, 1] < FREE)
        while row.size:
            own, top = row * (width + 1), row * (2 * width)
            root = low[top + 1]
            i = root & (width - 1)
            at = own + i
            j, h = after[at], before[at]
            k = after[own + j]
            after[at], before[own + k] = k, i
            new = symbol[at] = self.joined[root >> bits]
            symbol[own + j] = -1
            mine, prior = self._leaf(new, symbol[own + k], i, width), self._leaf(symbol[own + h], new, h, width)
            first = h == width
            leaves = np.stack([j, i, np.where(first, i, h)]) + width
            low[top + leaves] = np.stack([np.full(len(row), FREE), mine, np.where(first, mine, prior)])
            for _ in range(bits):
                pair = top + (leaves & -2)
                leaves >>= 1
                low[top + leaves] = np.minimum(low[pair], low[pair + 1])
            row = row[low[top + 1] < FREE]
        return ids[:, :-1]


class Tokenizer:
    """A byte-level BPE vocabulary with word ends, as its JSON file describes it."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.end = model["model"].get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs = {}
        for rank, (a, b) in enumerate(model["model"]["merges"] if isinstance(model["model"]["merges"][0], list) else (m.split(" ") for m in model["model"]["merges"])):
            joined = self.vocab.get(a + b)
            if a in self.vocab and b in self.vocab and joined is not None:
                self.pairs.setdefault(self.vocab[a] << 32 | self.vocab[b], (rank, joined))
        self.table = Pairs(self.pairs)
        self.letter, self.last = (np.array([self.vocab.get(x + end, -1) for x in byte_letters()], np.int64) for end in ("", self.end))
        self.pieces = regex.compile(PIECES)
        self.spaced = regex.compile(r"\P{White_Space}+")
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: By word (special tokens: by id), the ids as bytes and their decoding.
        self.ids: dict[str | int, bytes] = {}
        self.words: dict[str | int, str] = {}
        self._renew()

    def _renew(self) -> None:
        self.old = self.ids, self.words
        self.ids, self.words = {i: i.to_bytes(4, "little") for i in self.special.values()}, {i: s for s, i in self.special.items()}

    def _merged(self, pieces: list[str]) -> tuple[list[bytes], list[str]]:
        """The merged ids of each piece and their decoding. Long ones are merged one at a time, the others together by the
        widths of their trees."""
        raw = [p.encode() for p in pieces]
        ends = np.cumsum([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.letter[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        there = ids >= 0
        ends, ids = np.cumsum(there)[ends - 1], ids[there]
        lengths = np.diff(ends, prepend=0)
        bits = np.frexp(np.maximum(lengths, 2) - 1)[1]
        out, said = [b""] * len(raw), [""] * len(raw)
        for b in np.unique(bits).tolist():
            rows, width = np.flatnonzero(bits == b), 1 << b
            if width > LONG:
                for r in rows.tolist():
                    mine = merge(ids[ends[r] - lengths[r] : ends[r]].tolist(), self.pairs)
                    out[r], said[r] = np.array(mine, "<u4").tobytes(), self.decode(mine)
                continue
            mine = np.full((len(rows), width), -1)
            mine[np.arange(width) < lengths[rows, None]] = ids[np.isin(np.repeat(bits, lengths), b)]
            mine = self.table.merge(mine)
            left = mine >= 0
            flat, at = mine[left], 0
            joined, tokens = flat.astype("<u4").tobytes(), [self.token[i] for i in flat.tolist()]
            for r, n in zip(rows.tolist(), left.sum(1).tolist(), strict=True):
                out[r], said[r] = joined[4 * at : 4 * (at + n)], " ".join(tokens[at : at + n])
                at += n
        return out, said

    def decode(self, ids) -> str:
        """Tokens joined by a space: these vocabularies name no decoder."""
        return " ".join([self.token[i] for i in ids])

    def normal(self, text: str) -> str:
        if not text.isascii():
            # lower case is taken letter by letter, without the rule for a final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _words(self, text: str) -> list[str]:
        """What stands between white space, which no piece reaches across; the pieces of it where it is long."""
        text = self.normal(text)
        words = text.split() if not SEPARATORS.search(text) else self.spaced.findall(text)
        if max(map(len, words), default=0) > LONG:
            words = [p for w in words for p in (self.pieces.findall(w) if len(w) > LONG else [w])]
        return words

    def _learn(self, words: list[str]) -> None:
        """Words of one piece are those of ASCII letters, and others by the pattern."""
        more = {w: self.pieces.findall(w) for w in words if not (w.isascii() and w.isalpha())}
        pieces = list({*chain.from_iterable(more.values())}.union(w for w in words if w not in more))
        ids, said = (dict(zip(pieces, x, strict=True)) for x in self._merged(pieces))
        for w in words:
            if len(some := more.get(w, (w,))) == 1:
                self.ids[w], self.words[w] = ids[w], said[w]
            else:
                self.ids[w], self.words[w] = b"".join([ids[p] for p in some]), " ".join([said[p] for p in some])

    def _encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        words = []
        for text in texts:
            parts = self.split.split(text) if self.split else [text]
            words.append(self._words(text) if len(parts) == 1 else [w for p in parts for w in ([self.special[p]] if p in self.special else self._words(p))])
        new = []
        for w in set(chain.from_iterable(words)).difference(self.ids):
            if (found := self.old[0].get(w)) is not None:
                self.ids[w], self.words[w] = found, self.old[1][w]
            else:
                new.append(w)
        if new:
            self._learn(new)
        out = [(b"".join(map(self.ids.__getitem__, some)), " ".join(map(self.words.__getitem__, some))) for some in words]
        for w in new:
            if len(w) > LONG:
                del self.ids[w], self.words[w]
        if len(self.ids) > CACHE:
            self._renew()
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and their decoding. Equal texts are encoded once."""
        got, some, size = {}, [], 0
        for text in (each := list(dict.fromkeys(texts))):
            some.append(text)
            size += len(text)
            if size >= TOGETHER or len(got) + len(some) == len(each):
                got.update(zip(some, self._encode(some), strict=True))
                some, size = [], 0
        return [got[t] for t in texts]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and their decoding."""
        return self.encode_all([text])[0]


_ready: dict[str, Tokenizer] = {}


def encode(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but text) with n_tokens long, ids binary and decoded string.

    vocabulary: path of a tokenizer's JSON file; the driver reads it, and its size bounds what is broadcast. A null
    text counts as empty; an empty text has no tokens, empty ids and an empty decoding. Texts are encoded whole, those of
    rows that come together and are equal once: ties, repeated rows and extra columns change nothing.
    """
    spark = df.sparkSession
    tune(spark)
    spec, which = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8")), uuid.uuid4().hex
    keep = [c for c in df.columns if c != text] if keep is None else keep
    rows = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].cast("string").alias("t"))
    types = dict(df.dtypes)
    schema = ", ".join([*(f"k{i} {types[c]}" for i, c in enumerate(keep)), "n long, i binary, d string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if which not in _ready:
            _ready.clear()
            _ready[which] = Tokenizer(spec.value)
        t = _ready[which]
        for batch, column in texts(batches, len(keep)):
            for at in range(0, len(column), 500):
                got = t.encode_all([x or "" for x in column[at : at + 500]])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, 500) for i in range(len(keep))), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())], names=[*(f"k{i}" for i in range(len(keep))), "n", "i", "d"])

    out = rows.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias("n_tokens"), F.col("i").alias("ids"), F.col("d").alias("decoded"))

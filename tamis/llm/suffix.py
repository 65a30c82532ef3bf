"""Suffix-array dedup of long repeats across documents, by bucket-pointer refinement.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller key is removed. Each string
has an anchor, the least of the hashed GRAM-byte strings in it, so equal strings have equal anchors. Strings that follow each
other with one anchor are a run, and runs of equal bytes are of one kind: what holds for one of them holds for all.

Anchors meet first. An anchor with one kind of runs wherever it occurs is settled by the smallest document of that kind. The
suffixes that start in runs of an anchor with several kinds are bucketed by their first eight bytes, and buckets are refined
by pairs of bucket numbers here and at later offsets: 16, 32 and `length` bytes, each from the numbers before it. A bucket's
number is made from the pair alone, so that all packs number alike without meeting; the last numbers are dealt out, sorted,
and each bucket keeps the strings of its smallest document.

Texts travel in packs of a few MB. A pack sends one entry for an anchor, whatever its runs, and one for a bucket, so a line
in very many documents makes no more entries than there are packs, wherever it stands. Entries go in bundles to groups of
anchors or buckets, in as many rounds as keep a bundle large; answers name the entries that are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, release, tidy, tune

#: Bytes of text in a pack (one longer text is a pack of its own), bytes looked at together, bytes of an anchor.
PACK, SLICE, GRAM = 2 << 20, 1 << 18, 24
#: Text for which there is one group of entries, and groups at least; groups that entries are dealt to in a round.
GROUP_BYTES, GROUPS, FAN = 4 << 20, 64, 1 << 14
#: Entries that a task holds to be dealt out or answered together.
HELD = 1 << 18
#: Flags of an answer; stands for several kinds in place of one.
GONE, ASK = 1, 2
MANY = np.uint64(0)
LAST = np.iinfo(np.int64).max
K = 0xD6E8FEB86659FD93
K_BACK = pow(K, -1, 1 << 64)

_tables: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prepared(length: int) -> dict[str, np.ndarray]:
    if not _tables:
        n = SLICE + 2 * length + 2
        for name, k in (("up", K), ("down", K_BACK)):
            _tables[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, k, np.uint64)]), dtype=np.uint64)
        _tables["byte"] = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _tables


def runs(raw: np.ndarray, starts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The runs of a pack: first and last string start, document number, anchor hash, 64-bit hash of the run's bytes and shape."""
    t = _prepared(length)
    grams = length - GRAM + 1
    ends = starts[1:]
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(raw) - length + 1), SLICE):
        part = raw[at : at + SLICE + length - 1]
        n = len(part) - length + 1
        value = t["byte"][part]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value * t["up"][: len(part)], out=prefix[1:])
        h = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * t["down"][: len(prefix) - GRAM])
        # leftmost least gram of each string, by doubling
        least, off, size = h, np.zeros(len(h), np.uint8), 1
        while size < grams:
            step = min(size, grams - size)
            a, b = least[:-step], least[step:]
            right = b < a
            off = np.where(right, off[step:] + np.uint8(step), off[:-step])
            least = np.where(right, b, a)
            size += step
        anchor = np.arange(n) + off[:n]
        # strings that reach over a document's end are none
        doc = np.repeat(np.arange(len(ends)), np.clip(np.minimum(ends, at + n) - np.maximum(starts[:-1], at), 0, None))
        whole = at + np.arange(n) + length <= ends[doc]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
        s0 = np.flatnonzero(new)
        if not len(s0):
            continue
        stop = whole.copy()
        stop[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1])
        s1 = np.flatnonzero(stop)
        p = anchor[s0]
        text = (prefix[s1 + length] - prefix[s0]) * t["down"][s0]
        shape = ((s1 - s0) * 64 + (p - s0)).astype(np.uint64)
        # least hashes are small numbers: mixed again they spread over all groups. 48 bits of them do: anchors taken for one
        # are only asked about more, as the run's own 64 bits say what is equal
        out.append((s0 + at, s1 + at, doc[s0], _mixed(h[p] + np.uint64(K)) >> np.uint64(16) << np.uint64(16), _mixed(text ^ _mixed(shape + np.uint64(7)))))
    names = ("s0", "s1", "doc", "h", "c")
    if not out:
        return dict(zip(names, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)), strict=True))
    return dict(zip(names, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))


def kinds(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a pack's runs: the first of each kind (anchor and bytes), smallest document first; each run's kind; the first kind
    of each anchor; each kind's anchor. Kinds and anchors are numbered in order of their hashes."""
    order = np.lexsort((r["doc"], r["c"], r["h"]))
    h, c = r["h"][order], r["c"][order]
    new_h = np.append(True, h[1:] != h[:-1])[: len(h)]
    new = new_h | np.append(True, c[1:] != c[:-1])[: len(h)]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    head = np.flatnonzero(new_h[new])
    return order[new], kind, head, np.cumsum(new_h[new]) - 1


def anchors(keys: np.ndarray, r: dict[str, np.ndarray]) -> tuple:
    """What a pack sends: for each anchor its hash, its kind's or MANY, its smallest document; then what `kinds` gives."""
    rep, kind, head, of = kinds(r)
    c = np.where(np.bincount(of, minlength=len(head)) > 1, MANY, r["c"][rep[head]])
    least = np.minimum.reduceat(keys[r["doc"][rep]], head) if len(head) else np.empty(0, np.int64)
    return r["h"][rep[head]], c, least, rep, kind, of


def _unpack(keys: bytes, starts: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts_ = np.frombuffer(starts, np.int64)
    return np.frombuffer(keys, np.int64), starts_, np.frombuffer(zstandard.decompress(blob, max_output_size=max(1, int(starts_[-1]))) if starts_[-1] else b"", np.uint8)


def _count(n: np.ndarray) -> np.ndarray:
    """0, 1 ... n[0] - 1, 0, 1 ... n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [first, last) merged where they touch."""
    if not len(first):
        return first.astype(np.int64), last.astype(np.int64)
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:], len(first)) - 1]


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return _mixed(a * np.uint64(K) + _mixed(b + np.uint64(salt)))


def refine(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, of 64 and of 32 bits, of all strings of `length` bytes: equal for equal strings.

    Buckets of eight bytes are numbered by those bytes; twice as many bytes by the pair of buckets here and that far on.
    """
    gram = np.zeros(len(raw) - 7, np.uint64)
    for j in range(8):
        gram <<= np.uint64(8)
        gram |= raw[j : j + len(gram)]
    out = []
    for salt in (11, 29):
        bucket, size = gram, 8
        while size * 2 <= length:
            bucket, size = _pair(bucket[:-size], bucket[size:], salt), size * 2
        n = len(raw) - length + 1
        out.append(_pair(bucket[:n], bucket[length - size : length - size + n], salt))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def buckets(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the strings that start at `at`, refined over the stretches that they cover."""
    one, two = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32)
    order = np.argsort(at, kind="stable")
    place = at[order]
    first, last = _spans(place, place + length)
    # long stretches in slices that overlap by all but a byte of a string; short ones together
    cut = -(-(last - first - length + 1) // SLICE)
    begin = np.repeat(first, cut) + _count(cut) * SLICE
    end = np.minimum(begin + SLICE + length - 1, np.repeat(last, cut))
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(np.cumsum(end[i:] - begin[i:]), SLICE + length)) + i)
        size = end[i:j] - begin[i:j]
        offset = np.cumsum(size) - size
        x, y = refine(raw[np.repeat(begin[i:j], size) + _count(size)], length)
        s = slice(*np.searchsorted(place, [begin[i], end[j - 1] - length + 1]))
        part = np.searchsorted(begin[i:j], place[s], "right") - 1
        where = place[s] - begin[i:j][part] + offset[part]
        one[order[s]], two[order[s]] = x[where], y[where]
        i = j
    return one, two


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones and so on: what numbers have in common lies together."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(raw: np.ndarray, n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The first n numbers of planes, and the rest."""
    size = n * np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[:size].reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel(), raw[size:]


def scatter(parts: list[tuple], bits: int) -> list[tuple]:
    """Entries of packs by group, the upper `bits` of their hashes: (group, heads, entries). parts: (pack, number of the first
    entry, x, y, z), x the hashes in order; heads: pack, number of the first entry and entries, of each part in the group."""
    sizes = [len(p[2]) for p in parts]
    if not sum(sizes):
        return []
    x, y, z = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    g = (x >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    of = np.repeat(np.arange(len(parts)), sizes)[order]
    number = (np.repeat(np.array([p[1] for p in parts]), sizes) + _count(np.array(sizes)))[order]
    g, x, y, z = g[order], x[order], y[order], z[order]
    at = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (of[1:] != of[:-1])))
    heads = np.stack([np.array([p[0] for p in parts])[of[at]], number[at], np.diff(np.append(at, len(g)))], 1).astype(np.int64)
    cut = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    end = np.append(cut[1:], len(g))
    low, high = np.searchsorted(at, cut), np.searchsorted(at, end)
    squeeze = zstandard.ZstdCompressor(level=1)
    return [(int(g[i]), heads[p:q].tobytes(), squeeze.compress(_planes(np.diff(x[i:j], prepend=np.uint64(0))) + _planes(y[i:j]) + _planes(z[i:j]))) for i, j, p, q in zip(cut, end, low, high, strict=True)]


def _parts(rows: list[tuple], kind: type) -> list[tuple]:
    """What `scatter` was given, from its rows."""
    out = []
    for heads, entries in rows:
        heads = np.frombuffer(heads, np.int64).reshape(-1, 3)
        n = int(heads[:, 2].sum())
        rest = np.frombuffer(zstandard.decompress(entries), np.uint8)
        x, rest = _numbers(rest, n, np.uint64)
        y, rest = _numbers(rest, n, kind)
        z, _ = _numbers(rest, n, np.int64)
        x, at = np.cumsum(x, dtype=np.uint64), np.cumsum(heads[:, 2]) - heads[:, 2]
        out += [(int(b), int(first), x[i : i + k], y[i : i + k], z[i : i + k]) for (b, first, k), i in zip(heads, at, strict=True)]
    return out


def judge(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of entries of anchors: GONE if its kind is in a smaller document, ASK if the anchor has other kinds elsewhere."""
    order = np.lexsort((doc, c, h))
    hs, cs, ds = h[order], c[order], doc[order]
    new_h = np.append(True, hs[1:] != hs[:-1])
    new = new_h | np.append(True, cs[1:] != cs[:-1])
    least, of = ds[new], np.cumsum(new) - 1
    head, anchor = np.flatnonzero(new_h), np.cumsum(new_h) - 1
    entries_, kinds_ = np.diff(np.append(head, len(hs))), np.add.reduceat(new, head)
    one = cs != MANY
    gone = one & (ds > least[of])
    ask = ~gone & np.where(one, kinds_[anchor] > 1, entries_[anchor] > 1)
    out = np.empty(len(h), np.uint8)
    out[order] = gone * GONE + ask * ASK
    return out


def later(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of entries of buckets: GONE if a smaller document has the string."""
    order = np.lexsort((doc, two, one))
    new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
    out = np.empty(len(one), np.uint8)
    out[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    return out


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few MB."""
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size < 4 << 20):
            size += sum(len(x) for x in rows[end] if isinstance(x, bytes))
            end += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows[at:end], strict=True), types, strict=True)], names=names)
        at = end


BUNDLE = "g long, heads binary, entries binary"
BUNDLE_TYPES, BUNDLE_NAMES = [pa.int64(), pa.binary(), pa.binary()], ["g", "heads", "entries"]


def _answered(bundles: DataFrame, bits: int, kind: type, answer: Callable) -> DataFrame:
    """(b, n, flag): numbers and flags of those entries of each pack that `answer` flags, from bundles by groups."""

    def split(bits: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, size = None, [], 0
            for batch in batches:
                for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and (g != now or size > HELD):
                        yield from _batch(scatter(_parts(held, kind), bits), BUNDLE_TYPES, BUNDLE_NAMES)
                        held, size = [], 0
                    now = g
                    held.append(row)
                    size += int(np.frombuffer(row[0], np.int64)[2::3].sum())
            if held:
                yield from _batch(scatter(_parts(held, kind), bits), BUNDLE_TYPES, BUNDLE_NAMES)

        return run

    def reply(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        b, n, flag = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(b, kind="stable")
        b, n, flag = b[order], n[order], flag[order]
        cut = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
        yield from _batch([(int(b[i]), n[i:j].astype(np.uint32).tobytes(), flag[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)], [pa.int64(), pa.binary(), pa.binary()], ["b", "n", "flag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, size = None, [], [], 0

        def group() -> tuple | None:
            parts = _parts(held, kind)
            x, y, z = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
            flag = answer(x, y, z)
            at = np.flatnonzero(flag)
            sizes = np.array([len(p[2]) for p in parts])
            b = np.repeat(np.array([p[0] for p in parts]), sizes)
            n = np.repeat(np.array([p[1] for p in parts]), sizes) + _count(sizes)
            return (b[at], n[at], flag[at]) if len(at) else None

        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and g != now:
                    if got := group():
                        found.append(got)
                        size += len(got[0])
                    held = []
                    if size > HELD:
                        yield from reply(found)
                        found, size = [], 0
                now = g
                held.append(row)
        if held and (got := group()):
            found.append(got)
        if found:
            yield from reply(found)

    have = min(bits, FAN.bit_length() - 1)
    while have < bits:
        have = min(bits, have + FAN.bit_length() - 1)
        bundles = bundles.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(split(have)), BUNDLE)
    return bundles.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), "b long, n binary, flag binary")


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(key, the columns keep, n_bytes, spans, kept) for each row: the removed runs of bytes as array of struct of start and end (end
    excluded, byte offsets in the text) and the bytes that are left, as binary; as_text: as string, without the characters of which a part went.

    The key must be a whole number. A null key is larger than all others. Rows with equal keys are not smaller than each
    other, so they leave each other whole. A null text counts as empty; a text shorter than `length` loses nothing. Texts
    are taken whole; matches never cross documents; what is removed is judged on the texts as they come in.
    """
    spark = df.sparkSession
    tune(spark)
    keep = keep or []
    types = dict(df.dtypes)
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)

        def one(part: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
            part.sort(key=lambda x: x[0])
            rest = pa.RecordBatch.from_arrays([pa.array([x[3][i] for x in part], k) for i, k in enumerate([*kinds, pa.bool_()])], names=[str(i) for i in range(len(kinds) + 1)])
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), rest.schema) as writer:
                writer.write_batch(rest)
            starts = np.zeros(len(part) + 1, np.int64)
            np.cumsum([len(x[1]) for x in part], out=starts[1:])
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (np.array([x[0] for x in part], np.int64).tobytes(), starts.tobytes(), squeeze.compress(b"".join(x[1] for x in part)), sink.getvalue().to_pybytes())] + [pa.array([int(starts[-1])], pa.int64())], names=["keys", "starts", "blob", "rest", "size"])

        held, size = [], 0
        for batch in batches:
            kinds = batch.schema.types[2:]
            for k, t, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if held and size + len(raw) > PACK:
                    yield one(held, kinds)
                    held, size = [], 0
                held.append((LAST if k is None else k, raw, None, [*more, k is not None]))
                size += len(raw)
        if held:
            yield one(held, kinds)

    packs = Stage(docs.mapInArrow(tidy(pack), "keys binary, starts binary, blob binary, rest binary, size long").withColumn("b", F.monotonically_increasing_id()), "packs").df
    total = packs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = (max(GROUPS, -(-total // GROUP_BYTES)) - 1).bit_length()
    first = min(bits, FAN.bit_length() - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b, keys, starts, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keys, starts, raw = _unpack(keys, starts, blob)
                h, c, doc, *_ = anchors(keys, runs(raw, starts, length))
                held.append((b, 0, h, c, doc))
                size += len(h)
                if size > HELD:
                    yield from _batch(scatter(held, first), BUNDLE_TYPES, BUNDLE_NAMES)
                    held, size = [], 0
        yield from _batch(scatter(held, first), BUNDLE_TYPES, BUNDLE_NAMES)

    def gathered(answers: DataFrame) -> DataFrame:
        """A pack's answers: each task that gave some gave them in a few rows."""
        return answers.groupBy("b").agg(F.collect_list(F.struct("n", "flag")).alias("got"))

    sent = packs.select("b", "keys", "starts", "blob").mapInArrow(tidy(send), BUNDLE)
    judged = Stage(_answered(sent, bits, np.uint64, judge), "judged")
    del sent
    release(spark)

    def flags(got: list | None, n: int) -> np.ndarray:
        out = np.zeros(n, np.uint8)
        for x in got or []:
            out[np.frombuffer(x["n"], np.uint32)] = np.frombuffer(x["flag"], np.uint8)
        return out

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is settled in a pack, and entries of buckets for what isn't."""
        types, names = [pa.int64(), *[pa.binary()] * 4, *BUNDLE_TYPES], ["b", "first", "last", "place", "times", *BUNDLE_NAMES]
        held, size = [], 0

        def deal() -> Iterator[pa.RecordBatch]:
            yield from _batch([(*[None] * 5, *row) for row in scatter(held, first)], types, names)

        for batch in batches:
            for b, *pack_, got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, starts, raw = _unpack(*pack_)
                r = runs(raw, starts, length)
                h, c, _, rep, kind, of = anchors(keys, r)
                flag = flags(got, len(h))
                doc = keys[r["doc"]]
                least = doc[rep][kind]
                # of a kind, its smallest document's runs stay for now
                off = (doc > least) | (flag[of][kind] & GONE > 0)
                ask, sends = (flag & ASK > 0) | (c == MANY), flag & ASK > 0
                own = np.flatnonzero(~off & ask[of][kind])
                # each kind's strings, then all places where its runs put them
                own = own[np.argsort(kind[own], kind="stable")]
                some, head, times = np.unique(kind[own], return_index=True, return_counts=True)
                count = r["s1"][rep[some]] - r["s0"][rep[some]] + 1
                run_, nth = np.repeat(np.arange(len(some)), count), _count(count)
                one, two = buckets(raw, r["s0"][rep[some]][run_] + nth, length)
                string, owner = doc[rep[some]][run_], sends[of[some]][run_]
                order = np.lexsort((string, two, one))
                one, two, string, owner, run_, nth = (x[order] for x in (one, two, string, owner, run_, nth))
                new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
                bucket = np.cumsum(new) - 1
                gone = string > string[new][bucket]
                place = np.repeat(nth, times[run_]) + r["s0"][own[np.repeat(head[run_], times[run_]) + _count(times[run_])]]
                settled = np.repeat(gone, times[run_])
                x, y = _spans(np.concatenate([r["s0"][off], place[settled]]), np.concatenate([r["s1"][off], place[settled]]) + length)
                # entries are buckets of anchors that others have too
                out = new & owner
                entry = np.repeat(owner[new][bucket] & ~gone, times[run_])
                at = np.bincount(bucket[owner & ~gone], times[run_][owner & ~gone], len(new.nonzero()[0]))[owner[new]].astype(np.uint32)
                held.append((b, 0, one[out], two[out], string[out]))
                size += int(out.sum())
                yield from _batch([(b, x.tobytes(), y.tobytes(), zstandard.compress(_planes(place[entry].astype(np.uint32)), 1), zstandard.compress(_planes(at), 1), *[None] * 3)], types, names)
                if size > HELD:
                    yield from deal()
                    held, size = [], 0
        yield from deal()

    asked = packs.join(gathered(judged.df), "b", "left").select("b", "keys", "starts", "blob", "got")
    settled = Stage(asked.mapInArrow(tidy(settle), "b long, first binary, last binary, place binary, times binary, " + BUNDLE), "settled").df
    judged.drop()
    del asked
    release(spark)
    found = gathered(_answered(settled.where("g is not null").select("g", "heads", "entries"), bits, np.uint32, later))
    done = packs.join(settled.where("g is null").select("b", "first", "last", "place", "times"), "b").join(found, "b", "left").select("keys", "starts", "blob", "rest", "first", "last", "place", "times", "got")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *pack_, rest, first, last, place, times, got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, starts, raw = _unpack(*pack_)
                place, times = (np.frombuffer(zstandard.decompress(x), np.uint8) for x in (place, times))
                place, times = (_numbers(x, len(x) // 4, np.uint32)[0] for x in (place, times))
                more = place.astype(np.int64)[np.repeat(flags(got, len(times)) > 0, times)]
                first, last = np.concatenate([np.frombuffer(first, np.int64), more]), np.concatenate([np.frombuffer(last, np.int64), more + length])
                rest = pa.ipc.open_stream(rest).read_next_batch()
                known = rest.column(len(keep)).to_pylist()
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, last, -1)
                off = np.cumsum(edge[:-1]) > 0
                n = len(keys)
                for at in range(0, n, 500):
                    rows = []
                    for i in range(at, min(n, at + 500)):
                        s, e = starts[i], starts[i + 1]
                        o = off[s:e]
                        step = np.diff(o.view(np.int8), prepend=0, append=0)
                        rows.append((int(keys[i]) if known[i] else None, int(e - s), [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)], raw[s:e][~o].tobytes().decode("utf-8", "ignore") if as_text else raw[s:e][~o].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string() if as_text else pa.binary()), strict=True)] + [rest.column(i).slice(at, 500) for i in range(len(keep))], names=["key", "n", "spans", "kept", *(f"k{i}" for i in range(len(keep)))])

    more = "".join(f", k{i} {types[c]}" for i, c in enumerate(keep))
    out = done.mapInArrow(tidy(cut_out), "key long, n long, spans array<struct<start:bigint,end:bigint>>, kept " + ("string" if as_text else "binary") + more)
    return out.select(F.col("key").cast(types[key]).alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias("n_bytes"), "spans", "kept")

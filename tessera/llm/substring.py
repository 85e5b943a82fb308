"""Removal of long repeated word sequences by recompression.

Every text is read as a string of words and rewritten in rounds: maximal runs
of one symbol get one name, then pairs of a left and a right symbol do.  A
name is a hash of what it stands for, so all rounds in all tasks name equal
strings alike without exchanging a dictionary.  Within any window of
``window`` words a core of symbols is the same wherever the window stands,
as it depends on nothing outside; the longest symbol of the core, at the
highest level that has one, is the window's key.  Consecutive windows with
one key symbol make a segment.

Equal segments are found by one aggregation.  A window reaches at least half
of its remaining length to one side of its key symbol, so equal windows in
unequal segments agree there: windows are compared one by one only where that
side is shared by several segments, and only in each segment's first document.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _chunks, tidy
from tessera.operators.components import checkpoint_dir, cut, drop

#: Rounds of pair naming; in those listed runs are named first.
ROUNDS, RUNS = 4, (0, 2)
#: Most bits of a filter (32 MB); it has 16 for each entry, down to 2**20.
FILTER_BITS = 1 << 28
#: Characters of text parsed at a time, at most (a text is never cut).
PART = 1_000_000
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class _Level:
    """The symbols of one level over all words of a chunk of documents:
    names, first words, and for each word the symbol that begins there."""

    def __init__(self, name: np.ndarray, start: np.ndarray, n: int):
        self.name, self.start, self.n = name, start, n
        self.at = np.full(n + 1, -1, np.int32)
        self.at[start] = np.arange(len(start), dtype=np.int32)
        self.at[n] = len(start)


def _runs(level: _Level, edge: np.ndarray) -> tuple[_Level, np.ndarray, np.ndarray]:
    """Names maximal runs.  Also the first word that is safe on the right of
    each word where a core begins, and the last on the left of its end."""
    s, n = level.start, level.n
    new = np.ones(len(s), bool)
    new[1:] = (level.name[1:] != level.name[:-1]) | edge[s[1:]]
    heads = np.flatnonzero(new)
    length = np.diff(np.append(heads, len(s))).astype(np.uint64)
    name = np.where(length > 1, _mix(level.name[heads] * _M[1] + length), level.name[heads])
    out = _Level(name, s[heads], n)
    # The run at either rim may go on outside: it leaves the core.
    group = np.cumsum(new) - 1
    bounds = np.append(s[heads], n)
    right, left = np.full(n + 1, n, np.int32), np.zeros(n + 1, np.int32)
    right[s] = bounds[group + 1]
    left[s[1:]] = bounds[group[:-1]]
    left[n] = bounds[group[-1]]
    return out, right, left


def _pairs(level: _Level, edge: np.ndarray, salt: int) -> tuple[_Level, np.ndarray, np.ndarray]:
    s, n = level.start, level.n
    side = (_mix(level.name + _U(salt * int(_M[0]) % 2**64)) & _U(1)).astype(bool)  # True: right
    joined = np.zeros(len(s), bool)  # with the symbol before it
    joined[1:] = ~side[:-1] & side[1:] & ~edge[s[1:]]
    heads = np.flatnonzero(~joined)
    double = np.zeros(len(s), bool)
    double[:-1] = joined[1:]
    second = np.minimum(heads + 1, len(s) - 1)
    name = np.where(double[heads], _mix(level.name[heads] * _M[0] + _mix(level.name[second] + _M[1])), level.name[heads])
    out = _Level(name, s[heads], n)
    nexts = np.append(s[1:], n)
    right, left = np.full(n + 1, n, np.int32), np.zeros(n + 1, np.int32)
    right[s] = np.where(side, nexts, s)  # a right symbol may be taken from outside
    last = np.where(side, nexts, s)  # and so may a left symbol at the end
    left[nexts] = last
    return out, right, left


def _hashes(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and powers, for the hash of any stretch of words."""
    n = len(values)
    inverse = _U(pow(int(base), -1, 1 << 64))
    power = np.cumprod(np.concatenate([[_U(1)], np.full(n, base)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[_U(1)], np.full(n, inverse)]), dtype=np.uint64)
    return np.concatenate([[_U(0)], np.cumsum(values * back[:n], dtype=np.uint64)]), power


class Parse:
    """The segments of the windows of a list of documents."""

    def __init__(self, texts: list[str], window: int):
        import xxhash
        from collections import defaultdict
        from itertools import count

        number: dict[bytes, int] = defaultdict(count().__next__)
        get = number.__getitem__
        docs = [np.array([get(w) for w in t.encode("utf-8", "surrogatepass").split()], np.int32) for t in texts]
        wide = [xxhash.xxh3_128_digest(w) for w in number]
        table = np.frombuffer(b"".join(wide), "<u8").reshape(-1, 2) if wide else np.zeros((0, 2), np.uint64)
        del number, wide
        sizes = np.array([len(d) for d in docs], np.int64)
        self.window = window
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        n = len(flat)
        starts = np.arange(n)
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        open_ = starts + window <= self.first[1:][self.doc] if n else np.zeros(0, bool)
        self.p = np.flatnonzero(open_)  # where windows begin
        self.sum, self.power = [], []
        for i in (0, 1):
            s, w = _hashes(table[flat, i] if n else np.zeros(0, np.uint64), (_U(0x2545F4914F6CDD1D), _U(0x9FB21C651E98DF25))[i])
            self.sum.append(s)
            self.power.append(w)
        if len(self.p):
            edge = np.zeros(n + 1, bool)
            edge[self.first[:-1][sizes > 0]] = True
            self._keys(_Level(table[flat, 0].copy(), np.arange(n), n), edge)

    def hash(self, a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
        """Of the words from a up to b, wherever they stand."""
        return (self.sum[i][b] - self.sum[i][a]) * self.power[i][a]

    def _keys(self, level: _Level, edge: np.ndarray) -> None:
        p = self.p
        lo, hi = p.copy(), p + self.window
        key, at, size = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        live = np.arange(len(p))
        for t in range(ROUNDS):
            below, low, high = level, lo, hi
            rest = np.arange(len(live))  # of those that had a core below
            for step in (_runs,) * (t in RUNS) + (_pairs,):
                level, right, left = step(level, edge) if step is _runs else step(level, edge, t + 1)
                lo, hi = right[lo], left[hi]
                good = lo < hi
                if not good.all():
                    lo, hi, rest = lo[good], hi[good], rest[good]
            out = np.ones(len(live), bool)
            out[rest] = False
            self._choose(below, low[out], high[out], live[out], key, at, size, t)
            live = live[rest]
        self._choose(level, lo, hi, live, key, at, size, ROUNDS)
        new = np.ones(len(p), bool)
        new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1]) | (p[1:] != p[:-1] + 1)
        heads = np.flatnonzero(new)
        self.start, self.n = p[heads], np.diff(np.append(heads, len(p)))
        self.at, self.size, key = at[heads], size[heads], key[heads]
        # What equal windows share to the left or to the right of the symbol.
        self.reach = (self.window - self.size + 1) // 2
        self.has_left = self.start <= self.at - self.reach
        self.has_right = self.start + self.n - 1 + self.window - self.at - self.size >= self.reach
        none = np.zeros(len(heads), np.uint64)
        self.left, self.right = none.copy(), none.copy()
        for has, out, a, b, mark in ((self.has_left, self.left, self.at - self.reach, self.at + self.size, 1), (self.has_right, self.right, self.at, self.at + self.size + self.reach, 2)):
            out[has] = _mix(self.hash(a[has], b[has], 0) + _mix(key[has] + _U(mark)))

    @staticmethod
    def _choose(level: _Level, lo: np.ndarray, hi: np.ndarray, live: np.ndarray, key: np.ndarray, at: np.ndarray, size_: np.ndarray, t: int) -> None:
        """Of the symbols between two words the longest, of like ones the
        one of the largest hash, of equal ones the first."""
        if not len(live):
            return
        length = np.minimum(np.diff(np.append(level.start, level.n)), 255).astype(np.uint64)
        value = (length << _U(56)) | (_mix(level.name) >> _U(8))
        a, b = level.at[lo].astype(np.int64), level.at[hi].astype(np.int64)
        size = b - a
        best = np.zeros(len(live), np.int64)
        table, k = np.arange(len(value)), 0
        todo = np.frexp(size)[1] - 1  # the power of two within
        while True:
            now = np.flatnonzero(todo == k)
            if len(now):
                x, y = table[a[now]], table[b[now] - (1 << k)]
                best[now] = np.where(value[y] > value[x], y, x)
            if k >= todo.max() or len(table) <= 1 << k:
                break
            x, y = table[: -(1 << k)], table[1 << k :]
            table = np.where(value[y] > value[x], y, x)
            k += 1
        key[live] = _mix(level.name[best] + _U(t * int(_M[1]) % 2**64))
        at[live] = level.start[best]
        size_[live] = np.append(level.start, level.n)[best + 1] - level.start[best]


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column(part.num_columns - 1).to_pylist()]


def _segments(df: DataFrame, window: int) -> DataFrame:
    """doc_id, th (a hash of the text), start, n, ctx_l, ctx_r, h1, h2."""

    def run(batches):
        for batch in batches:
            for part in _chunks(batch, PART):
                got = Parse(_texts(part), window)
                if len(got.p):
                    a, n = got.start, got.n
                    d = got.doc[a]
                    h = [got.hash(a, a + n + window - 1, i).view(np.int64) for i in (0, 1)]
                    at = pa.array(d)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array((a - got.first[d]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(got.left.view(np.int64), mask=~got.has_left), pa.array(got.right.view(np.int64), mask=~got.has_right), *map(pa.array, h)], names=["doc_id", "th", "start", "n", "ctx_l", "ctx_r", "h1", "h2"])

    return df.where("doc_id is not null").select("doc_id", "th", "text").mapInArrow(tidy(run), f"doc_id {_kind(df)}, th bigint, start int, n int, ctx_l bigint, ctx_r bigint, h1 bigint, h2 bigint")


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


class Filter:
    """A Bloom filter of 64-bit numbers: what it lacks was never put in.  A
    false find must only ever keep a row."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    @staticmethod
    def slots(x: np.ndarray, size: int) -> np.ndarray:
        h = _mix(x.view(np.uint64))
        return np.stack([h & _U(size - 1), (h >> _U(32)) & _U(size - 1)])

    def has(self, x: np.ndarray) -> np.ndarray:
        at = self.slots(np.ascontiguousarray(x), 8 * len(self.packed))
        return ((self.packed[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1).all(axis=0)

    @staticmethod
    def of(numbers: DataFrame, count: int, within: Filter | None = None) -> Filter:
        """From one bigint column; at most FILTER_BITS whatever the count.
        With ``within``, only of rows whose second number that filter has."""
        size = min(FILTER_BITS, 1 << max(20, (16 * count).bit_length()))
        shared, within_there = numbers.sparkSession.sparkContext.broadcast(within), within is not None

        def run(batches):
            packed = np.zeros(size // 8, np.uint8)
            for b in batches:
                x = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False))
                if within_there:
                    x = x[shared.value.has(b.column(1).to_numpy(zero_copy_only=False))]
                at = Filter.slots(x, size).ravel()
                np.bitwise_or.at(packed, (at >> _U(3)).astype(np.int64), _U(128).astype(np.uint8) >> (at & _U(7)).astype(np.uint8))
            packed = packed.reshape(-1, 4096)
            some = np.flatnonzero(packed.any(axis=1))
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in packed[part]], pa.binary())], names=["block", "bits"])

        out = np.zeros((size // 8 // 4096, 4096), np.uint8)
        for r in numbers.mapInArrow(tidy(run), "block int, bits binary").toLocalIterator():  # a partition's filter at a time
            out[r.block] |= np.frombuffer(r.bits, np.uint8)
        return Filter(out.ravel())


def _windows(df: DataFrame, window: int, filters: tuple[Filter, Filter, Filter]) -> DataFrame:
    """doc_id, th, start, w1, w2 of the windows to compare: ``filters`` tell
    shared sides, segments of several documents, and the first documents of
    all segments that the second filter has, by chance or not."""
    shared = df.sparkSession.sparkContext.broadcast(filters)  # at most FILTER_BITS each

    def run(batches):
        sides, again, firsts = shared.value
        for batch in batches:
            for part in _chunks(batch, PART):
                got = Parse(_texts(part), window)
                if not len(got.p):
                    continue
                ids = part.column(2).to_numpy()
                d = got.doc[got.start]
                h = got.hash(got.start, got.start + got.n + window - 1, 0).view(np.int64)
                left, right = got.has_left & sides.has(got.left), got.has_right & sides.has(got.right)
                good = (left | right) & (~again.has(h) | firsts.has(ids[d] ^ h))
                if not good.any():
                    continue
                a, n = got.start[good], got.n[good]
                before = np.concatenate([[0], np.cumsum(n)])
                k = np.repeat(np.flatnonzero(good), n)
                p = np.arange(before[-1]) + np.repeat(a - before[:-1], n)
                p = p[left[k] & (got.at[k] - p >= got.reach[k]) | right[k] & (p + window - got.at[k] - got.size[k] >= got.reach[k])]
                d = got.doc[p]
                for i in range(0, len(p), 100_000):
                    q, e = p[i : i + 100_000], d[i : i + 100_000]
                    at = pa.array(e)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array((q - got.first[e]).astype(np.int32)), *(pa.array(got.hash(q, q + window, j).view(np.int64)) for j in (0, 1))], names=["doc_id", "th", "start", "w1", "w2"])

    return df.where("doc_id is not null").select("doc_id", "th", F.xxhash64("doc_id"), "text").mapInArrow(tidy(run), f"doc_id {_kind(df)}, th bigint, start int, w1 bigint, w2 bigint")


def _kept(segs: DataFrame, again: Filter) -> DataFrame:
    """Segments that the filter has, before they are shuffled."""
    shared = segs.sparkSession.sparkContext.broadcast(again)

    def run(batches):
        for b in batches:
            good = pa.array(shared.value.has(b.column(b.schema.get_field_index("h1")).to_numpy()))
            yield b.filter(good)

    return segs.mapInArrow(tidy(run), segs.schema)


def repeats(df: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id, th, start, n``: stretches of ``n`` windows, from the word
    ``start`` on, that also start in a document with a smaller id.  ``df``
    has ``doc_id``, ``text`` and ``th``, a hash of the text."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"
    stored = lambda name: spark.read.parquet(f"{base}/{name}")
    _segments(df, window).write.parquet(f"{base}/segments")
    segs = stored("segments")
    # One row a segment; its sides are a function of its words.
    segs.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("ctx_l").alias("ctx_l"), F.max("ctx_r").alias("ctx_r")).write.parquet(f"{base}/firsts")
    firsts = stored("firsts")
    shared = firsts.where("lo < hi")
    n = shared.count()
    again = Filter.of(shared.select("h1"), n)
    whole = _kept(segs.select("doc_id", "th", "start", "n", "h1", "h2"), again).join(shared.select("h1", "h2", "lo"), ["h1", "h2"]).where("doc_id > lo").select("doc_id", "th", "start", "n")
    sides = firsts.select(F.explode(F.array("ctx_l", "ctx_r")).alias("x")).where("x is not null").groupBy("x").count().where("count > 1").select("x")
    sides.write.parquet(f"{base}/sides")
    # Also of segments of one document that `again` has by chance.
    own = firsts.select(F.xxhash64("lo").bitwiseXOR(F.col("h1")).alias("x"), "h1")
    filters = Filter.of(stored("sides"), stored("sides").count()), again, Filter.of(own, n, again)
    _windows(df, window, filters).write.parquet(f"{base}/windows")
    found = stored("windows")
    twice = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    single = found.join(twice, ["w1", "w2"]).where("doc_id > lo").select("doc_id", "th", "start", F.lit(1).alias("n"))
    out = cut(whole.union(single))
    drop(spark, base)  # nothing reads it again
    return out


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept binary`` for every row: the words
    covered by no window of ``window`` words that also starts in a document
    with a smaller id, joined by single spaces (UTF-8).

    Words are what ASCII white space parts.  Null and empty texts, and texts
    shorter than a window, lose nothing; nor do rows with a null id, which
    also take nothing from others.  Of rows repeated under one id none is
    before the other, so repeats among them stay.  Ids are of any type that
    has an order, and come back in it.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    stretch = repeats(docs, window).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("s"))
    joined = docs.join(stretch, ["doc_id", "th"], "left")

    def run(batches):
        for batch in batches:
            for part in _chunks(batch, PART):
                total, removed, kept = [], [], []
                lists, texts = part.column(1), part.column(2).to_pylist()
                for i, t in enumerate(texts):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    cover = np.zeros(len(words) + 1, np.int32)
                    if lists[i].is_valid:
                        v = lists[i].values
                        a = v.field("start").to_numpy().astype(np.int64)
                        np.add.at(cover, a, 1)
                        np.add.at(cover, a + v.field("n").to_numpy() + window - 1, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    total.append(len(words))
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed[-1] else words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "s", "text").mapInArrow(tidy(run), f"doc_id {_kind(docs)}, n_words bigint, n_removed bigint, kept binary")

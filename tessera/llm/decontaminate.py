"""Benchmark decontamination by winnowing.

Of the k-gram hashes in every sliding window of an item's words the smallest
is kept as a fingerprint, on the test side and on the training side.  With k
words a gram and w grams a window every shared span of k + w - 1 words has a
shared fingerprint; each hit is extended to the windows of ``span`` words
around it, compared word by word.

A test side of bounded size is sent to all tasks.  Beyond that both sides are
joined: a filter of all fingerprints tells which of a document's windows are
worth a row, and those meet the items' windows by 128 bits of their words.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _chunks, map_texts, tidy
from tessera.llm.substring import Filter
from tessera.operators.components import cut

#: ASCII other than digits and lower-case letters parts words (texts are
#: lower-cased in A-Z only, so no upper-case letter is left).
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    # bytes.lower() changes A-Z only
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _gram_hash(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k word numbers."""
    n = len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    for i in range(k):
        h = (h ^ (x[i : i + n] * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of each w in a row."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(n) + windows.argmin(axis=1))


class Tests:
    """Fingerprints and windows of test items.

    Words are numbered by the items' own vocabulary; a document's word that
    no item has is -1 and ends every run.  Items shorter than ``span`` are
    one window each, with grams as long as the shortest such window allows.
    """

    def __init__(self, items: list[tuple[str, str | None]], span: int = 13, gram: int = 8):
        self.span, self.ids, self.names = span, {}, []
        self.windows: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        self.grams: dict[int, tuple[int, int]] = {}
        for name, text in items:
            words = words_of(text or "")
            if not words:
                continue
            n = min(len(words), span)
            k = min(gram, n)
            self.grams[n] = k, n - k + 1
            ids = np.array([self.ids.setdefault(x, len(self.ids)) for x in words], np.int32)
            prints[n].append(_gram_hash(ids, k)[_winnow(_gram_hash(ids, k), n - k + 1)])
            number = len(self.names)
            self.names.append(name)
            for i in range(len(ids) - n + 1):
                have = self.windows[n].setdefault(ids[i : i + n].tobytes(), [])
                if not have or have[-1] != number:
                    have.append(number)
        self.prints = {n: np.unique(np.concatenate(p)) for n, p in prints.items()}

    def hits(self, text: str) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, positions of those hit, items with windows."""
        words = words_of(text)
        get = self.ids.get
        ids = np.array([get(x, -1) for x in words], np.int32)
        hit, found = np.zeros(len(ids), bool), set()
        if not len(ids) or ids.max() < 0:
            return len(ids), np.zeros(0, np.int32), found
        # Runs of known words that could hold a window.
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        for n, (k, w) in self.grams.items():
            for a, b in edges[edges[:, 1] - edges[:, 0] >= n].tolist():
                run = ids[a:b]
                h = _gram_hash(run, k)
                at = _winnow(h, w)
                at = at[_within(self.prints[n], h[at])]
                if not len(at):
                    continue
                table, last = self.windows[n], -1
                for i in at.tolist():
                    for j in range(max(i - w + 1, last + 1), min(i, len(run) - n) + 1):
                        last = j
                        got = table.get(run[j : j + n].tobytes())
                        if got:
                            hit[a + j : a + j + n] = True
                            found.update(got)
        return len(ids), np.flatnonzero(hit).astype(np.int32), found


def _within(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", span: int = 13, gram: int = 8, block_bytes: int = 16_000_000) -> DataFrame:
    """``keep``, ``n_words``, ``hit array<int>`` (positions of hit words, in
    order) and ``items array<string>`` (ids of items with windows in the
    text, sorted as strings) for every document.

    A test side of at most ``block_bytes`` of text is sent to all tasks and
    every text is read once, in place; a larger one is joined.  The rows are
    the same.  Nulls and empty texts have no words; items without words have
    no window; an item without an id hits words and is not listed; repeated
    rows of ``docs`` each get their row, repeated items count once by id.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null")
    kinds = dict(docs.dtypes)
    kept = ", ".join(f"{c} {kinds[c]}" for c in keep)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > block_bytes:
        return _joined(docs, items, text, keep, span, gram)
    block = [(r.id, r.text) for r in items.toLocalIterator()]  # block_bytes of text at most
    shared = docs.sparkSession.sparkContext.broadcast(Tests(block, span, gram))

    def run(_, texts: list[str]) -> list:
        tests = shared.value
        n, hit, found = zip(*map(tests.hits, texts))
        names = [sorted({tests.names[i] for i in x if tests.names[i] is not None}) for x in found]
        return [pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]

    return map_texts(docs, text, f"{kept}, n_words bigint, hit array<int>, items array<string>", run, list(keep))


class _Windows:
    """Hashes of the words of a text, and of any window of them."""

    def __init__(self, text: str):
        import xxhash

        words = words_of(text)
        wide = {w: xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in set(words)}
        self.word = np.frombuffer(b"".join(wide[w] for w in words), "<u8").reshape(-1, 2)

    def prints(self, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Fingerprints of runs of n words, where they stand, and how many
        grams a window has."""
        k = min(gram, n)
        h = _gram_hash(self.word[:, 0], k)
        at = _winnow(h, n - k + 1)
        return (h[at] * _MIX + np.uint64(n)).view(np.int64), at, n - k + 1

    def windows(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        """Two numbers for the n words from each place on."""
        out = []
        for i in (0, 1):
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = (h ^ (self.word[at + j, i] * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            out.append(h.view(np.int64))
        return out


def _joined(docs: DataFrame, items: DataFrame, text: str, keep: tuple[str, ...], span: int, gram: int) -> DataFrame:
    """``scan`` by joins, for a test side of any size."""
    sized = items.withColumn("n", F.least(F.regexp_count(_lowered("text"), F.lit(_WORD.pattern)), F.lit(span)).cast("int")).where("n > 0")
    sizes = sorted(r.n for r in sized.select("n").distinct().collect())  # span numbers at most

    def prints(batches):
        for batch in batches:
            for part in _chunks(batch, 1_000_000):
                for t, n in zip(part.column(1).to_pylist(), part.column(0).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(_Windows(t).prints(n, gram)[0])], names=["fp"])

    def windows(batches):
        for batch in batches:
            for part in _chunks(batch, 1_000_000):
                for name, n, t in zip(*(part.column(i).to_pylist() for i in range(3))):
                    w = _Windows(t)
                    got = w.windows(np.arange(len(w.word) - n + 1), n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(got[0]), pa.string()), pa.array(np.full(len(got[0]), n, np.int32)), *map(pa.array, got)], names=["id", "n", "w1", "w2"])

    fps = cut(sized.select("n", "text").mapInArrow(tidy(prints), "fp bigint").distinct())
    known = docs.sparkSession.sparkContext.broadcast(Filter.of(fps, fps.count()))  # of bounded size; a false find costs a row
    tests = sized.select("id", "n", "text").mapInArrow(tidy(windows), "id string, n int, w1 bigint, w2 bigint").distinct()
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__x"))
    inner = inner.withColumns({"__a": F.xxhash64("__x"), "__b": F.xxhash64("__x", F.lit(1))})

    def candidates(batches):
        for batch in batches:
            for part in _chunks(batch, 1_000_000):
                for a, b, t in zip(*(part.column(i).to_pylist() for i in range(3))):
                    w = _Windows(t)
                    for n in sizes:
                        last = len(w.word) - n
                        if last < 0:
                            break
                        fp, at, wide = w.prints(n, gram)
                        at = at[known.value.has(fp)]
                        if not len(at):
                            continue
                        start = np.unique((at[:, None] - np.arange(wide)).ravel())
                        start = start[(start >= 0) & (start <= last)]
                        one = np.ones(len(start), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(one * a), pa.array(one * b), pa.array(start.astype(np.int32)), pa.array((one * n).astype(np.int32)), *map(pa.array, w.windows(start, n))], names=["__a", "__b", "start", "n", "w1", "w2"])

    # Equal texts have equal hits, so one row for each text is enough.
    met = inner.select("__a", "__b", "__x").mapInArrow(tidy(candidates), "__a bigint, __b bigint, start int, n int, w1 bigint, w2 bigint").distinct().join(tests, ["n", "w1", "w2"])
    hits = met.groupBy("__a", "__b").agg(F.collect_set(F.struct("start", "n")).alias("s"), F.sort_array(F.collect_set("id")).alias("items"))
    hit = F.sort_array(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))))
    hits = hits.select("__a", "__b", hit.alias("hit"), "items")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    n_words = F.regexp_count(_lowered("__x"), F.lit(_WORD.pattern)).cast("bigint").alias("n_words")
    return inner.join(hits, ["__a", "__b"], "left").select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], n_words, none("hit", "array<int>"), none("items", "array<string>"))


def _lowered(c: str):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def verdicts(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",), share: int = 20) -> DataFrame:
    """The digest of ``scan``: counts, the hex SHA-256 of the item ids and
    ``contaminated`` (at least one word in ``share`` is hit)."""
    return scanned.select(*keep, "n_words", F.size("hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.size("hit") > 0) & (F.size("hit") * share >= F.col("n_words"))).alias("contaminated"))

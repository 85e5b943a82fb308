"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a part of the corpus are laid end to end as one
array of symbols.  An inverted index maps each mergeable token pair to the
positions where it stands; merges are replayed in rank order, each one over
all its positions at once, and only the touched neighbours are looked up and
indexed anew.  A task keeps the ids of the pre-tokens that it has met, so each
is merged once.  As merges never cross a pre-token, replaying parts gives the
same ids as replaying the whole corpus, so nothing is shuffled and a lost
task is simply run again.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_texts

_NONE = np.int32(2**31 - 1)
#: Characters of a chunk; those of its new pre-tokens take some 55 bytes of
#: arrays each.
CHUNK = 2_000_000
#: Pre-tokens that a task remembers, about; then it begins anew.
MEMO = 400_000

# White space as the public tokenizer's regular expressions see it (Unicode
# White_Space: unlike Python's \s, without the separators 0x1C to 0x1F).
_SPACE = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pattern for texts of Latin letters only, for the faster engine.
# Letters come first: no two alternatives before the last three begin alike.
_LATIN = re.compile(rf" ?[{_LETTER}]+| ?[{_NUMBER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER = re.compile("[^\x00-ɏ‐-›€]")


class Replay:
    """The merges of one vocabulary, and pre-tokenisation for its pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {r: t for t, r in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.general = regex.compile(pattern)
        self.width = max(ranks.values()) + 1
        pairs = {ranks[t[:i]] * self.width + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]

        self.forget()

    def forget(self) -> None:
        """Numbers of pre-tokens, their ids end to end, where each begins."""
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, texts: list[str]) -> list[np.ndarray]:
        """The pre-tokens of each text by number; new ones are merged."""
        if len(self.number) > MEMO:
            self.forget()
        old, number = len(self.number), self.number
        docs = [np.array([number[w] for w in self.split(t)], np.int32) for t in texts]
        if len(number) > old:
            ids, starts = self.encode(islice(number, old, None))
            self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        return docs

    def split(self, text: str) -> list[str]:
        return self.general.findall(text) if _OTHER.search(text) else _LATIN.findall(text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where each word starts
        (with the end of the last)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.concatenate([[0], np.cumsum(size + 1)])  # a gap after each word
        n = int(starts[-1])
        sym = np.full(n + 1, -1, np.int32)
        inside = np.ones(n + 1, bool)
        inside[starts[1:] - 1] = False
        inside[n] = False
        sym[inside] = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        nxt = np.arange(1, n + 2, dtype=np.int32)
        nxt[-1] = n
        prv = np.arange(-1, n, dtype=np.int32)
        prv[0] = n
        rank = np.full(n + 1, _NONE, np.int32)
        rank[:n] = self._rank(sym[:-1], sym[1:])

        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            edges = [0, *cut.tolist(), len(at)]
            for r, a, b in zip(ranks[edges[:-1]].tolist(), edges, edges[1:]):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(at[a:b])

        live = np.flatnonzero(rank != _NONE)
        if len(live):
            enter(live, rank[live])
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping pairs the leftmost, as in "aaa"
                linked = nxt[at[:-1]] == at[1:]
                if linked.any():
                    k = np.arange(len(at))
                    head = np.concatenate([[True], ~linked])
                    at = at[(k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = r
            sym[gone] = -2
            rank[gone] = _NONE
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            before = before[(before != n) & (sym[before] >= 0)]
            touched = np.concatenate([at, before]) if len(before) else at
            new = self._rank(sym[touched], sym[nxt[touched]])
            rank[touched] = new
            good = new != _NONE
            if good.any():
                enter(touched[good], new[good])
        kept = sym >= 0
        before = np.concatenate([[0], np.cumsum(kept)])
        return sym[kept], before[np.minimum(starts, n)]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """Encodes every whole text: ``keep``, ``ids array<int>`` and, with
    ``decode``, ``decoded binary``, the bytes that the ids stand for.

    Special tokens are ordinary text.  Nulls and empty texts give no ids.
    Repeated rows stay; other columns are not looked at.  ``ranks_path`` must
    be readable on the executors.
    """

    def setup() -> Replay:
        return Replay(ranks_path, pattern)

    def run(state: Replay, texts: list[str]) -> list:
        docs = state.learn(texts)
        words = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        ends = np.cumsum([0, *map(len, docs)])
        out, where = _gather(state.ids, state.starts, np.diff(state.starts), words)
        offsets = where[ends].astype(np.int32)
        made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))]
        if decode:
            blob, at = _spell(state, out)
            stops = at[offsets].astype(np.int32)
            made.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(blob)]))
        return made

    kept = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
    return map_texts(df, text, f"{kept}, ids array<int>" + ", decoded binary" * decode, run, list(keep), setup, CHUNK)


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a sequence of words, and where each word's begin."""
    sizes = lengths[words]
    where = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(where[-1], dtype=np.int64) + np.repeat(starts[words] - where[:-1], sizes)
    return ids[at], where


def _spell(state: Replay, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of a sequence of ids, and where each id's begin."""
    blob = b"".join(map(state.tokens.__getitem__, ids.tolist()))
    sizes = np.zeros(state.width, np.int64)
    sizes[list(state.tokens)] = [len(t) for t in state.tokens.values()]
    return blob, np.concatenate([[0], np.cumsum(sizes[ids])])

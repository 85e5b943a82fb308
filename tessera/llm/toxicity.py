"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed embeddings of the word and of its
beginnings, each zero if it hardly occurs in training and else begun with how
surely it goes with the label; filters of several widths run over the words,
the maximum of each over the whole text is kept, and a logistic layer reads
the maxima.  Trained in numpy on a bounded sample of labelled rows.  The
constants were chosen by cross-validation within the training rows of the
given tables.  Thresholds are
calibrated by language, which is itself told from the text alone, on all
labelled rows that the sample lacks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts
from tessera.llm.langid import _grams
from tessera.llm.substring import Filter, _kept

_WORD = re.compile(r"[^\W_]+")
#: Rows of the embedding table, its width, filters of each width, widths.
ROWS, WIDTH, FILTERS, SPANS = 1 << 17, 8, 8, (1, 2, 3)
#: Lengths of a word's beginnings that have embeddings of their own.
BEGINNINGS = (4, 5, 6)
#: Training texts that a word or beginning occurs in, at least, to have one.
LEAST = 2
#: Labelled rows that training takes at most, of each label, and bytes of
#: their texts (whole texts, the first by hash of the id).
SAMPLE, SAMPLE_BYTES = 2000, 64_000_000
#: One in so many labelled ids is never trained on, only calibrated on.
APART = 5
#: Steps of the histogram of scores.
BINS = 1024
#: Positives of all languages that weigh in each language's threshold.
PRIOR = 20
#: The score at which a text counts as toxic.
CUT = 0.3


def _features(word: str) -> tuple[int, ...]:
    code = lambda x, salt: zlib.crc32(x.encode("utf-8", "replace"), salt) % ROWS
    return code(word, 0), *(code(word[:n], n) for n in BEGINNINGS)


@dataclass
class Model:
    table: np.ndarray  # ROWS and one of zeros
    known: np.ndarray  # rows with an embedding
    filters: list[np.ndarray]  # for each width: width x WIDTH x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    langs: np.ndarray = field(default_factory=lambda: np.zeros((0, 4096)))  # log-likelihoods of n-grams
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))  # raw probability that is CUT, by language

    @staticmethod
    def new(seed: int) -> Model:
        rng = np.random.default_rng(seed)
        return Model(np.vstack([rng.normal(0, 0.1, (ROWS, WIDTH)), np.zeros((1, WIDTH))]).astype(np.float32), np.zeros(ROWS, bool), [rng.normal(0, 0.3, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS], np.zeros(FILTERS * len(SPANS), np.float32), rng.normal(0, 0.3, FILTERS * len(SPANS)).astype(np.float32), -1.0)

    def pooled(self, words: np.ndarray, starts: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters for documents that begin at ``starts`` in
        ``words`` (numbers of rows of ``feats``; -1 parts documents), and
        where they are."""
        emb = self.table[feats].sum(axis=1)
        emb = np.vstack([emb, np.zeros((1, WIDTH), np.float32)])
        best, where = [], []
        for s, f in zip(SPANS, self.filters):
            total = (emb @ f[0])[words]
            for i in range(1, s):
                total[:-i] += (emb @ f[i])[words[i:]]
            high = np.maximum.reduceat(total, starts, axis=0)
            best.append(high)
            where.append(total)
        z = np.concatenate(best, axis=1) + self.bias
        return np.maximum(z, 0), where

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30)))

    def language(self, texts: list[str]) -> np.ndarray:
        if not len(self.langs):
            return np.zeros(len(texts), int)
        return np.array([int((self.langs @ _grams(t, self.langs.shape[1])).argmax()) for t in texts], int)

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores from 0 to 1; texts without words score as one empty word."""
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < 1_000_000):
                size += len(texts[stop])
                stop += 1
            words, starts, feats = _lay(texts[at:stop], self.known)
            out[at:stop] = self.raw(self.pooled(words, starts, feats)[0])
            at = stop
        if len(self.cuts):
            cut = self.cuts[self.language(texts)]
            out = np.where(out < cut, out / np.maximum(cut, 1e-9) * CUT, CUT + (out - cut) / np.maximum(1 - cut, 1e-9) * (1 - CUT))
        return np.clip(out, 0, 1)


def _lay(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts (each followed by gaps as wide as the
    widest filter needs), where each begins, features of each word."""
    from collections import defaultdict
    from itertools import count

    number: dict[str, int] = defaultdict(count().__next__)
    get = number.__getitem__
    gap = np.full(max(SPANS), -1, np.int64)
    parts, starts, at = [], [], 0
    for t in texts:
        ids = np.array([get(w) for w in _WORD.findall(t.lower())], np.int64)
        parts += [ids, gap]
        starts.append(at)
        at += len(ids) + len(gap)
    feats = np.array([_features(w) for w in number], np.int64).reshape(-1, 1 + len(BEGINNINGS))
    feats[~known[feats]] = ROWS
    return np.concatenate(parts), np.array(starts), feats


def _begin(model: Model, seen: Iterable[set[int]], y: np.ndarray) -> None:
    """Embeddings to begin with: the first number is the log odds of the
    label given the word or beginning, over its standard error."""
    all_, toxic = Counter(), Counter()
    for s, v in zip(seen, y):
        all_.update(s)
        if v == 1:
            toxic.update(s)
    rows = np.array([f for f, n in all_.items() if n >= LEAST], np.int64)
    model.known[rows] = True
    a = np.array([toxic[f] for f in rows.tolist()], np.float64)
    b = np.array([all_[f] for f in rows.tolist()]) - a
    odds = np.log((a + 0.5) / ((y == 1).sum() + 1)) - np.log((b + 0.5) / ((y == 0).sum() + 1))
    model.table *= 0.3
    model.table[rows, 0] = np.clip(odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) / 3, -1, 1.5)
    for f in model.filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.3
    model.out[:] = np.abs(model.out)
    model.bias[:] = -0.1


def train(texts: list[str], labels: list[int], langs: list[str | None], rounds: int = 6, seed: int = 7) -> Model:
    """Fits a model without thresholds; the same input gives the same model."""
    model = Model.new(seed)
    y = np.array(labels, np.float32)
    if not len(texts) or y.min() == y.max():
        model.out[:] = 0
        model.out_bias = -4.0 if not len(texts) or y.max() == 0 else 4.0
        return model
    rng = np.random.default_rng(seed)
    used = rng.permutation(len(texts))
    _begin(model, ({f for w in set(_WORD.findall(t.lower())) for f in _features(w)} for t in texts), y)
    weight = np.where(y == 1, min(4.0, (y == 0).sum() / (y == 1).sum()), 1.0)
    params = [model.table, *model.filters, model.bias, model.out]
    sq = [np.full(p.shape, 1e-4, np.float32) for p in params]
    bias_sq, rate = 1e-4, 0.05
    laid = [(b, *_lay([texts[i] for i in b], model.known)) for b in np.array_split(used, max(1, len(used) // 40))]
    for r in range(rounds):
        for k in rng.permutation(len(laid)):
            b, words, starts, feats = laid[k]
            pooled, totals = model.pooled(words, starts, feats)
            d = (model.raw(pooled) - y[b]) * weight[b] / len(b)
            grads = [np.zeros_like(p) for p in params[1:]]
            grads[-1] += pooled.T @ d
            dz = np.outer(d, model.out) * (pooled > 0)
            grads[-2] += dz.sum(axis=0)
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            ends = np.append(starts[1:], len(words))
            for si, s in enumerate(SPANS):
                total, f = totals[si], model.filters[si]
                for doc in np.flatnonzero(np.abs(dz[:, si * FILTERS : (si + 1) * FILTERS]).sum(axis=1)):
                    a = starts[doc]
                    top = total[a : ends[doc]].argmax(axis=0) + a
                    g = dz[doc, si * FILTERS : (si + 1) * FILTERS]
                    for i in range(s):
                        at = np.minimum(top + i, len(words) - 1)
                        w = words[at]
                        ok = w >= 0
                        if not ok.any():
                            continue
                        e = model.table[feats[w[ok]]].sum(axis=1)
                        grads[si][i][:, ok] += (e * g[ok, None]).T
                        touched.append((feats[w[ok]], f[i][:, ok].T * g[ok, None]))
            for p, g, q in zip(params[1:], grads, sq[1:]):
                q += g * g
                p -= rate * g / np.sqrt(q)
            bias_sq += d.sum() ** 2
            model.out_bias -= rate * d.sum() / np.sqrt(bias_sq)
            if touched:
                rows = np.concatenate([x.ravel() for x, _ in touched])
                vals = np.concatenate([np.repeat(v, 1 + len(BEGINNINGS), axis=0) for _, v in touched])
                rows, vals = rows[rows < ROWS], vals[rows < ROWS]
                u, inv = np.unique(rows, return_inverse=True)
                g = np.zeros((len(u), WIDTH), np.float32)
                np.add.at(g, inv, vals)
                sq[0][u] += g * g
                model.table[u] -= rate * g / np.sqrt(sq[0][u])
    names = sorted({x for x in langs if x})
    counts = np.full((len(names), 4096), 0.5)
    for t, x in zip(texts, langs):
        if x:
            counts[names.index(x)] += _grams(t, 4096)
    model.langs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return model


def set_cuts(model: Model, counts: np.ndarray, weight: np.ndarray) -> None:
    """Thresholds from counts by told language, label and bin of the score;
    ``weight`` is how many labelled rows a counted one of each label stands for."""
    overall = _best_cut(counts.sum(axis=0), weight)
    model.cuts = np.full(len(counts), overall)
    for k, own in enumerate(counts):  # a language with few positives keeps near the cut of all
        share = own[1].sum() / (own[1].sum() + PRIOR)
        model.cuts[k] = share * _best_cut(own, weight, overall) + (1 - share) * overall


def _best_cut(counts: np.ndarray, weight: np.ndarray, otherwise: float = 0.5) -> float:
    """The middle of the gap that gives the best F1, if both labels occur."""
    if counts.sum(axis=1).min() < 5:
        return otherwise
    full = np.flatnonzero(counts.sum(axis=0))[::-1]
    clean, hits = np.cumsum(counts[:, full] * weight[:, None], axis=1)
    k = int((2 * hits / (hits + clean + hits[-1])).argmax())
    low = full[k + 1] + 1 if k + 1 < len(full) else 0
    return float(np.clip((full[k] + low) / 2 / BINS, 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Trains on at most ``sample`` labelled rows of each label (the smallest
    hashes of the id, so as good as drawn) and SAMPLE_BYTES of their texts
    (whole ones; rows that would go beyond are only calibrated on), and sets
    the thresholds on all other labelled rows; one id in APART is always among
    those.  Each label weighs there as in the whole tables, so thresholds do
    not depend on what the sample took.

    Null labels, ids and texts teach nothing; of several labels for one id
    the highest counts, of several texts the least one trains.  Without rows of both labels the model is constant.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    # Ids first: `sample` of each label, whatever the size of the tables.
    there = known.join(rows.select("id"), "id", "left_semi")
    apart = F.pmod(F.xxhash64("id", F.lit(APART)), F.lit(APART)) == 0
    ids = None
    for y in (0, 1):
        one = there.where(~apart & (F.col("y") == y)).orderBy(F.xxhash64("id"), "id").limit(sample)
        ids = one if ids is None else ids.union(one)
    there_too = rows.where("text is not null").join(F.broadcast(ids), "id").groupBy("id", "y")
    room, taken = SAMPLE_BYTES, []
    for r in there_too.agg(F.octet_length(F.min("text")).alias("n")).orderBy(F.xxhash64("id"), "id").collect():  # 2 x sample rows of numbers
        if r.n <= room:
            room -= r.n
            taken.append((r.id, r.y))
    ids = ids.sparkSession.createDataFrame(taken, ids.schema)
    picked = rows.where("text is not null").join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("r")).select("id", "y", "r.*").orderBy("id").collect()  # SAMPLE_BYTES
    model = train([r.text for r in picked], [r.y for r in picked], [r.lang for r in picked])
    if len({r.y for r in picked}) == 2:
        outside = there.join(F.broadcast(ids.select("id")), "id", "left_anti")
        total, left = ({r.y: r["count"] for r in x.groupBy("y").count().collect()} for x in (there, outside))
        weight = np.array([total.get(y, 0) / max(1, left.get(y, 0)) for y in (0, 1)])
        set_cuts(model, _counts(rows, outside, sum(left.values()), model), weight)
    return model


def _counts(rows: DataFrame, labelled: DataFrame, n: int, model: Model) -> np.ndarray:
    """Rows by told language, label and bin of the score.  Texts stay where
    they are: a filter tells the ``n`` labelled ids, what it has by chance
    leaves in the join."""
    wanted = Filter.of(labelled.select(F.xxhash64("id")), n)
    some = _kept(rows.where("id is not null and text is not null").select("id", "text", F.xxhash64("id").alias("h1")), wanted)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(_, texts: list[str]) -> list:
        bins = np.minimum(shared.value.score(texts) * BINS, BINS - 1)
        return [pa.array(shared.value.language(texts), pa.int32()), pa.array(bins.astype(np.int32))]

    scored = map_texts(some, "text", f"id {dict(some.dtypes)['id']}, told int, bin int", run, ["id"])
    out = np.zeros((max(1, len(model.langs)), 2, BINS))
    for r in scored.join(labelled, "id").groupBy("told", "y", "bin").count().collect():  # languages x 2 x BINS
        out[r.told, r.y, r.bin] = r["count"]
    return out


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score double`` for every whole text.  Null and empty
    texts have the score of a text without words."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # ROWS x WIDTH and less

    def run(_, texts: list[str]) -> list:
        return [pa.array(shared.value.score(texts), pa.float64())]

    kept = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
    return map_texts(df, text, f"{kept}, score double", run, list(keep))

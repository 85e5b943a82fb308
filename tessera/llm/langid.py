"""Language ID by inference in a mixture of languages.

A document's n-grams are taken as draws from a mixture of the learned
languages.  Expectation-maximisation estimates the proportions; the set of
languages is the one with the best penalised likelihood, grown from the best
single language in the order of the proportions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

_ALPHA = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Profile:
    """Languages in order, and log-likelihoods of hashed byte trigrams."""

    langs: tuple[str, ...]
    logp: np.ndarray  # languages x buckets


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L is in the text (so not
    for superscripts, fractions or Roman numerals of their own)."""
    return any(map(str.isalpha, text))


def _grams(text: str, buckets: int) -> np.ndarray:
    """Counts of the hashed byte trigrams of the lower-cased words."""
    b = np.frombuffer((" " + " ".join(_ALPHA.findall(text.lower())) + " ").encode("utf-8", "replace"), np.uint8)
    if len(b) < 3:
        return np.zeros(buckets, np.int64)
    x = b.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - (buckets - 1).bit_length())
    return np.bincount(h, minlength=buckets)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 4096) -> Profile:
    """Counts n-grams over every row with a language; no sample is taken.

    Rows with a null language are passed over, null texts count nothing.
    The driver receives languages x ``buckets`` sums, whatever the number of
    rows.  An empty table gives a profile without languages.
    """
    rows = df.select(F.col(f"`{lang}`").alias("__lang"), F.col(f"`{text}`").alias("__text")).where("__lang is not null")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = _grams(value or "", buckets)
                sums[name] = sums[name] + got if name in sums else got
        if sums:
            full = {k: np.flatnonzero(v) for k, v in sums.items()}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, v in full.items() for _ in v], pa.string()), pa.array(np.concatenate(list(full.values())).astype(np.int32)), pa.array(np.concatenate([sums[k][v] for k, v in full.items()]).astype(np.int64))], names=["lang", "bucket", "n"])

    got = rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    seen = got.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    counts = np.full((len(seen), buckets), 0.5)
    for i, r in enumerate(seen):
        counts[i, r.b] += r.n
    return Profile(tuple(r.lang for r in seen), np.log(counts / counts.sum(axis=1, keepdims=True)))


def _em(c: np.ndarray, p: np.ndarray, pi: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents (rows of ``c``) under
    the mixture of languages ``p``; zero proportions stay zero."""
    for _ in range(rounds):
        pi = pi * ((c / np.maximum(pi @ p, 1e-30)) @ p.T) / n
    return pi, (c * np.log(np.maximum(pi @ p, 1e-30))).sum(axis=1)


def infer(c: np.ndarray, profile: Profile, rounds: int = 12, spread: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its proportion, and all proportions in the chosen set.

    ``spread`` allows for neighbouring n-grams that say the same thing: the
    likelihood counts 1/``spread`` of them as independent.
    """
    p = np.exp(profile.logp).astype(np.float32)
    c = c.astype(np.float32)
    docs, k = len(c), len(p)
    n = np.maximum(c.sum(axis=1, keepdims=True), 1)
    single = c @ profile.logp.T.astype(np.float32)
    best = single.argmax(axis=1)
    chosen = np.zeros((docs, k), np.float32)
    chosen[np.arange(docs), best] = 1
    if k > 1:
        pi, _ = _em(c, p, np.full((docs, k), 1 / k, np.float32), n, rounds)
        pi[np.arange(docs), best] += 1e-6
        order = np.argsort(-pi, axis=1, kind="stable")
        value = single.max(axis=1) / spread
        penalty = 0.5 * np.log(np.maximum(n[:, 0] / spread, 2))
        open_ = np.arange(docs)
        for size in range(2, k + 1):
            allowed = np.zeros((len(open_), k), bool)
            np.put_along_axis(allowed, order[open_, :size], True, axis=1)
            start = np.where(allowed, pi[open_], 0)
            start = start / start.sum(axis=1, keepdims=True)
            got, ll = _em(c[open_], p, start, n[open_], rounds // 2)
            ll = ll / spread - penalty[open_] * (size - 1)
            better = ll > value[open_]
            open_, got, ll = open_[better], got[better], ll[better]
            if not len(open_):
                break
            chosen[open_], value[open_] = got, ll
    top = chosen.argmax(axis=1)
    return top, chosen[np.arange(docs), top], chosen


def identify(df: DataFrame, profile: Profile, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred string``, ``score double`` (the language's
    proportion) and ``mixture string`` (``lang:proportion`` pairs of the
    chosen set) for every whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing
    was learned.  Equal proportions fall to the language first in order.
    """
    shared = df.sparkSession.sparkContext.broadcast(profile)  # languages x buckets, bounded

    def run(_, texts: list[str]) -> list:
        known = shared.value
        buckets = known.logp.shape[1] if len(known.langs) else 4096
        lang, score, mix = [], [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            if not known.langs:
                lang += ["und"] * len(part)
                score += [0.0] * len(part)
                mix += [""] * len(part)
                continue
            top, share, chosen = infer(np.stack([_grams(t, buckets) for t in part]), known)
            for t, k, s, row in zip(part, top.tolist(), share.tolist(), chosen):
                some = has_letter(t)
                lang.append(known.langs[k] if some else "und")
                score.append(min(1.0, s) if some else 0.0)
                mix.append(",".join(f"{known.langs[i]}:{row[i]:.3f}" for i in np.flatnonzero(row > 0.0005)) if some else "")
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())]

    kept = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
    return map_texts(df, text, f"{kept}, lang_pred string, score double, mixture string", run, list(keep))

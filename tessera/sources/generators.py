"""Relations made of nothing: ranges, the whole numbers, the primes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lexer import AlgebraError
from tessera.plans.scope import Endless, Scope

#: Numbers that one task sieves at a time.
SEGMENT = 1 << 20


def make(spark: SparkSession, options: dict) -> Scope:
    low = {k.lower(): v for k, v in options.items()}
    kind = low.get("name", "")
    number = lambda key, default=None: _integer(kind, key, low.get(key, default))
    if kind == "Range":
        lo, hi, step = number("lo"), number("hi"), number("step", "1")
        if step < 1:
            raise AlgebraError("Range takes a positive step")
        return Scope.of(spark.range(lo, hi + 1, step).toDF("n"))
    if kind == "Naturals":
        return _endless(spark, lambda count, offset: spark.range(offset, offset + count).toDF("n"), lambda top: spark.range(0, top + 1).toDF("n"))
    if kind == "Primes":
        return _endless(spark, lambda count, offset: _nth(spark, count, offset), lambda top: primes(spark, top))
    raise AlgebraError(f"no generator {kind!r}")


def _integer(kind: str, key: str, text) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        raise AlgebraError(f"{kind} takes a whole number {key}") from None


def _endless(spark: SparkSession, first, below) -> Scope:
    bare = Scope.of(spark.range(0).toDF("n"))
    fit = lambda df: Scope(df.select(F.col("n").alias(bare.cols[0].id)), bare.cols)
    return Scope(bare.df, bare.cols, endless=Endless(lambda count, offset=0: fit(first(count, offset)), lambda top: fit(below(top))))


def primes(spark: SparkSession, top: int) -> DataFrame:
    """``n``: the primes up to ``top``, a sieve of its own for each segment."""
    if top < 2:
        return spark.range(0).toDF("n")

    def sieve(batches):
        import pandas as pd

        root = math.isqrt(top)
        small = np.ones(root + 1, bool)
        small[:2] = False
        for p in range(2, math.isqrt(root) + 1):
            if small[p]:
                small[p * p :: p] = False
        base = np.flatnonzero(small)
        for pdf in batches:
            for k in pdf["id"]:
                lo, hi = k * SEGMENT, min(top + 1, (k + 1) * SEGMENT)
                own = np.ones(hi - lo, bool)
                own[: max(0, 2 - lo)] = False
                for p in base:
                    if p * p >= hi:
                        break
                    start = max(p * p, -(-lo // p) * p)
                    own[start - lo :: p] = False
                yield pd.DataFrame({"n": np.flatnonzero(own).astype(np.int64) + lo})

    return spark.range(top // SEGMENT + 1).mapInPandas(sieve, "n bigint")


def _nth(spark: SparkSession, count: int, offset: int) -> DataFrame:
    k = max(6, count + offset)
    top = int(k * (math.log(k) + math.log(math.log(k)))) + 1  # holds for k >= 6
    return primes(spark, top).orderBy("n").offset(offset).limit(count)

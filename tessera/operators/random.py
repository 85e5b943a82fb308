"""Samples and draws.  Seeds make them repeatable on the same data; which
rows come differs from other engines, only their distribution is promised."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.components import cut
from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.lower import Lowering, handles
from tessera.plans.scope import Endless, Scope


def _rand(seed):
    return F.rand() if seed is None else F.rand(seed)


@handles(ir.Sample)
def _sample(lo: Lowering, n: ir.Sample, outer) -> Scope:
    s = lo.finite(n.input, outer)
    if n.rows is None:
        return s.with_df(s.df.filter(_rand(n.seed) < n.fraction))
    # an order with a limit: each partition keeps its own smallest draws
    return s.with_df(s.df.withColumn("__r", _rand(n.seed)).orderBy("__r").limit(n.rows).drop("__r"))


@handles(ir.Shuffle)
def _shuffle(lo: Lowering, n: ir.Shuffle, outer) -> Scope:
    s = lo.finite(n.input, outer)
    return s.with_df(s.df.withColumn("__r", _rand(n.seed)).orderBy("__r").drop("__r"))


@handles(ir.Roll)
def _roll(lo: Lowering, n: ir.Roll, outer) -> Scope:
    """Draws with replacement, without end until limited.  Faces get an
    interval of the unit each; draws fall into them by a bucketed join, so
    neither side is sent whole."""
    s = lo.finite(n.input, outer)
    weight = lo.value(n.weight, s, outer).cast("double") if n.weight is not None else F.lit(1.0)

    def draws(count: int, offset: int = 0) -> Scope:
        # Cut, so that rows keep their partitions between the passes.
        faces = cut(s.df.withColumn("__w", F.coalesce(weight, F.lit(0.0))))
        total, least, many = faces.agg(F.sum("__w"), F.min("__w"), F.count(F.lit(1))).first()
        if not many:
            return s.with_df(s.df)
        if least < 0 or not total:
            raise AlgebraError("ROLL takes weights of at least zero, not all zero")
        # Running weights: sums of partitions first, then within each.
        faces = faces.withColumn("__p", F.spark_partition_id()).withColumn("__q", F.monotonically_increasing_id())
        sums = faces.groupBy("__p").agg(F.sum("__w").alias("__s"))
        before = sums.withColumn("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("__p", "__b")
        faces = faces.join(F.broadcast(before), "__p")  # a row a partition
        run = F.sum("__w").over(Window.partitionBy("__p").orderBy("__q").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        faces = faces.withColumn("__hi", (F.col("__b") + run) / total).withColumn("__lo", F.col("__hi") - F.col("__w") / total).filter("__w > 0")
        cells = max(1, min(many, 1 << 20))
        cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
        faces = faces.withColumn("__c", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")))))
        rolls = lo.spark.range(count).withColumn("__u", _rand(n.seed)).withColumn("__d", cell(F.col("__u")))
        met = rolls.join(faces, (F.col("__d") == F.col("__c")) & (F.col("__u") >= F.col("__lo")) & ((F.col("__u") < F.col("__hi")) | (F.col("__hi") >= 1 - 1e-12)))
        return s.with_df(met.select(*[x.id for x in s.cols]))

    return Scope(s.df, s.cols, endless=Endless(draws))

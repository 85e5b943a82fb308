"""Connected components of an edge relation, and cutting lineage safely."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, shared by all executors; a
    folder of our own only where none is set in a local session (as in
    tests).  A cluster without one is an error: its executors would write to
    disks that no other sees."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that we wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that what follows can be
    run again without what came before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge, where ``component`` is
    the smallest node reachable.  Edges have no direction; those with a null
    end are left out; loops make a component of one.

    Alternates large-star and small-star steps until the edges are stars.
    A step joins each edge with its node's smallest neighbour, so a hub's
    edges are split like any skewed join and no group is collected.
    """
    kept = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    loops = kept.where("x = y").select(F.col("x").alias("node")).distinct()
    # Reused in every round (and for nodes that only have loops).
    e = cut(kept.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = _state(e)
    if before[0]:
        for _ in range(max_rounds):
            both = e.union(e.select("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
            e = cut(small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct())
            now = _state(e)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return stars.union(roots.union(alone).distinct()).groupBy("node").agg(F.min("component").alias("component"))

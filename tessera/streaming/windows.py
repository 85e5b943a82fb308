"""Structured Streaming forms of the time-series operators.

The algebra's DOWNSAMPLE and filters run on streams as they are; here are the
forms that need a watermark or state.  Rows later than ``late`` behind the
newest are dropped by the watermark, as Spark documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.components import checkpoint_dir


def _timed(df: DataFrame, at: str, late: str) -> DataFrame:
    """With a watermark; a time without a zone is UTC."""
    if isinstance(df.schema[at].dataType, T.TimestampNTZType):
        df = df.withColumn(at, F.col(at).cast("timestamp"))
    return df.withWatermark(at, late)


def tumbling(df: DataFrame, at: str, width: str, aggs: list[Column], per: tuple[str, ...] = (), late: str = "1 day", slide: str | None = None) -> DataFrame:
    """``per…, bucket, aggs…`` for each window of ``width`` (sliding with
    ``slide``)."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    got = _timed(df, at, late).groupBy(*per, w).agg(*aggs)
    return got.select(*per, F.col("window.start").alias("bucket"), *[c for c in got.columns if c not in (*per, "window")])


def sessions(df: DataFrame, at: str, gap: str, aggs: list[Column], per: tuple[str, ...] = (), late: str = "1 day") -> DataFrame:
    """``per…, started, ended, aggs…`` of each run of rows without a silence
    longer than ``gap``."""
    got = _timed(df, at, late).groupBy(*per, F.session_window(at, gap)).agg(F.max(at).alias("ended"), *aggs)
    return got.select(*per, F.col("session_window.start").alias("started"), *[c for c in got.columns if c not in (*per, "session_window")])


def labelled(df: DataFrame, at: str, gap_seconds: float, per: str, name: str) -> DataFrame:
    """Every row with its session's number (from 1) in its key; the state of
    a key is its last time and number.  Rows of a batch are put in order; a
    row before its key's last time stays in the session then open."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        labels = []
        for t in rows[at]:
            seconds = None if pd.isna(t) else t.timestamp()
            if seconds is not None:
                if last is None or seconds > last + gap_seconds:
                    n += 1
                last = seconds if last is None else max(last, seconds)
            labels.append(max(n, 1))
        rows[name] = labels
        state.update((last, n))
        yield rows

    return df.groupBy(per).applyInPandasWithState(run, schema, "last double, n bigint", "append", "NoTimeout")


def drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives over all that its source holds now, as a batch
    DataFrame; results and progress go to the shared checkpoint folder."""
    spark: SparkSession = df.sparkSession
    base = f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    query = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/progress").foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")

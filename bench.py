"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.  Every query runs
once to warm up and then BENCH_RUNS times (median) into a noop sink, so all
of its columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessera import queries as core

HEADLINE = ("flagship", "group", "rollup", "theta_join", "semi_join", "anti_join", "asof_join", "interval_join", "top_per", "rolling_range", "window_rank", "sessionize", "downsample", "pivot", "unpivot", "divide", "forall", "symmetric_difference", "closure_from", "path", "cluster", "solve", "a_percentile", "a_collect", "exists", "lateral")


def sort_texts(spark: SparkSession, kind: str):
    """The only timings that the baseline lists: 100,000 texts in order."""
    from pyspark.sql import functions as F

    text = F.concat(F.lit("item-"), F.pmod(F.xxhash64("id"), F.lit(1_000_000))) if kind == "text" else F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(2_000_000_000))), "yyyy-MM-dd")
    from tessera.session import Session

    df = spark.range(100_000).select(text.alias("t")).cache()
    df.count()
    return Session(spark).table("T", df).relation("τ t (T)").df


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = core.queries()
    runs = {k: lambda k=k: made[k](spark, sf_dir) for k in HEADLINE}
    runs |= {f"sort_100k_{k}": lambda df=sort_texts(spark, k): df for k in ("text", "date")}
    times = {}
    for name, build in runs.items():
        spent = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            began = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - began)
        times[name] = round(statistics.median(spent[1:]), 4)
    print(json.dumps({"metric": "headline queries, warm, median", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

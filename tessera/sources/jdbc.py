"""Tables of databases through Spark's JDBC source, which sends filters,
aggregates, limits and joins to the database where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lexer import AlgebraError
from tessera.sources.files import declared, spark_type

#: How a table is read by several tasks: the whole-number, date or timestamp
#: column to split by, the number of parts, and the column's least and
#: greatest values (asked for where they are not given; no row is left out
#: by them).
SPLIT = ("partition", "partitions", "lower", "upper")
KEYS = ("url", "user", "password", "dialect", "collation", *SPLIT)
PARTS = 16


def checked(options: dict) -> dict:
    unknown = [k for k in options if k not in (*KEYS, "from")]
    if unknown:
        raise AlgebraError(f"a database connection has no {', '.join(unknown)}")
    if "url" not in options:
        raise AlgebraError("a database connection has a url")
    return options


def read(spark: SparkSession, options: dict, table: str, schema: dict | None = None) -> DataFrame:
    """Columns are pruned and filters pushed by Spark.  With a collation that
    is not declared ``exact`` nothing that compares strings is pushed.  With
    ``partition`` a task reads each range of that column; rows where it is
    NULL come with the first."""
    reader = spark.read.format("jdbc").option("url", options["url"]).option("dbtable", table).option("pushDownPredicate", options.get("collation") == "exact" or "collation" not in options)
    for k in ("user", "password"):
        if k in options:
            reader = reader.option(k, options[k])
    by = options.get("partition")
    if by:
        low, high = options.get("lower"), options.get("upper")
        if low is None or high is None:
            ends = reader.load().agg(F.min(by).alias("a"), F.max(by).alias("b")).first()  # the database computes it
            low, high = (ends.a if low is None else low), (ends.b if high is None else high)
        if low is not None:  # else the table is empty
            reader = reader.option("partitionColumn", by).option("numPartitions", int(options.get("partitions", PARTS))).option("lowerBound", str(low)).option("upperBound", str(high))
    df = reader.load()
    if not schema:
        return df
    out = []
    for name, kind in declared(schema).items():
        have = next((c for c in df.columns if c.lower() == name.lower()), None)
        if have is None:
            raise AlgebraError(f"{table} has no column {name}")
        # numbers keep the database's own type
        out.append((F.col(f"`{have}`") if kind in ("NUMBER", "ANY") else F.col(f"`{have}`").cast(spark_type(kind))).alias(name))
    return df.select(*out)

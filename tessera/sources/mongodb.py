"""Collections of MongoDB, where its Spark connector is on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lexer import AlgebraError
from tessera.sources.files import declared, spark_type


def read(spark: SparkSession, options: dict, table: str, schema: dict | None = None) -> DataFrame:
    for k in ("uri", "database"):
        if k not in options:
            raise AlgebraError(f"a mongodb connection has a {k}")
    try:
        df = spark.read.format("mongodb").option("connection.uri", options["uri"]).option("database", options["database"]).option("collection", table).load()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e):
            raise AlgebraError("the MongoDB Spark connector is not installed") from e
        raise
    if not schema:
        return df
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[n.lower()]}`") if n.lower() in have else F.lit(None)).cast(spark_type(k)).alias(n) for n, k in declared(schema).items()])

"""Delimited and JSON files, and the literal tables of scripts.

Files are read by Spark's own readers, so they split and prune.  Types that
are not declared are inferred from all records, in one pass over the file.
"""

from __future__ import annotations

import datetime
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import durations
from tessera.plans.lexer import AlgebraError

EXACT = T.DecimalType(38, 10)
_SIMPLE = {"NUMBER": EXACT, "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "TIME": T.StringType(), "ANY": T.StringType(), "DURATION": T.DayTimeIntervalType()}
_ZONED = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("offset_s", T.IntegerType())])
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
_DATE = re.compile(r"\d{4}-\d\d-\d\d")
_STAMP = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?")


def spark_type(kind) -> T.DataType:
    """The Spark type of a declared one."""
    if isinstance(kind, list):
        return T.ArrayType(spark_type(kind[0]))
    if isinstance(kind, dict):
        return T.StructType([T.StructField(n, spark_type(t)) for n, t in kind.items()])
    return _ZONED if kind == "TIMESTAMPTZ" else _SIMPLE[kind]


def declared(schema: dict) -> dict:
    return {n: (c["type"] if isinstance(c, dict) and "type" in c else c) for n, c in schema.items()}


def converted(text, kind: str):
    """A column of text as a declared type; text that is none is an error
    when it is read (Spark's ANSI casts)."""
    if kind in ("STRING", "ANY", "TIME"):
        return text
    if kind == "BOOLEAN":
        low = F.lower(F.trim(text))
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(text.isNotNull(), F.raise_error(F.concat(F.lit("no BOOLEAN: "), text)).cast("boolean"))
    if kind == "DURATION":
        return F.expr("null").cast("interval day to second") if text is None else _interval(text)
    if kind == "TIMESTAMPTZ":
        from tessera.functions import scalar

        return scalar.build("TO_TIMESTAMPTZ", [text], [T.StringType()])
    return text.cast(spark_type(kind))


def _interval(text):
    """ISO-8601 text of exact length, as an interval of days to seconds."""
    part = lambda unit, where: F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"{where}([+-]?\d+(?:\.\d+)?){unit}"), F.lit(1)), F.lit(1)).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    days = part("D", "P") + part("W", "P") * 7
    return F.when(text.isNotNull(), F.make_dt_interval(days.cast("int"), part("H", "T").cast("int"), part("M", "T(?:[0-9.]+H)?").cast("int"), part("S", "T(?:[0-9.]+H)?(?:[0-9.]+M)?")))


def read_csv(spark: SparkSession, path: str, options: dict, sep: str = ",") -> DataFrame:
    """``header`` (true), and ``schema`` or ``columns`` or neither.  An empty
    field is NULL; a row that ends early is an error."""
    header = options.get("header", True)
    schema, columns = options.get("schema"), options.get("columns")
    if schema and columns:
        raise AlgebraError("a source declares its schema or its columns, not both")
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "FAILFAST").option("nullValue", "").option("emptyValue", "").option("escape", '"').option("enforceSchema", False)
    if schema:
        kinds = declared(schema)
        names = list(kinds)
        raw = _raw(reader, path, names if not header else None)
        missing = [n for n in names if n.lower() not in {c.lower() for c in raw.columns}]
        if missing:
            raise AlgebraError(f"{path} has no column {', '.join(missing)}")
    else:
        raw = _raw(reader, path, columns if not header else None)
        if columns and header:
            raw = raw.toDF(*columns, *raw.columns[len(columns) :]).select(*columns)
        if not header and not columns:
            raise AlgebraError(f"{path} has no header: give its columns or a schema")
        kinds = inferred(raw)
    return raw.select(*[converted(F.col(f"`{_cased(raw, n)}`"), k).alias(n) for n, k in kinds.items()])


def _cased(df: DataFrame, name: str) -> str:
    return next((c for c in df.columns if c == name), None) or next(c for c in df.columns if c.lower() == name.lower())


def _raw(reader, path: str, names: list[str] | None) -> DataFrame:
    """All fields as text."""
    if names:
        return reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    return reader.option("inferSchema", False).csv(path)


def inferred(raw: DataFrame) -> dict[str, str]:
    """The narrowest type that all values of each column of text read as;
    STRING if there are none."""
    tests = {"NUMBER": rf"\s*({_NUMBER.pattern})\s*", "BOOLEAN": r"\s*(?i:true|false)\s*", "DATE": rf"\s*{_DATE.pattern}\s*", "TIMESTAMP": rf"\s*{_STAMP.pattern}\s*"}
    some = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
    got = raw.agg(*[F.bool_and(some(c).rlike(f"^(?:{p})$")).alias(f"{i}{k}") for i, c in enumerate(raw.columns) for k, p in tests.items()]).first()
    return {c: next((k for k in tests if got[f"{i}{k}"]), "STRING") for i, c in enumerate(raw.columns)}


def read_json(spark: SparkSession, path: str, records: str | None = None, lines: bool = False) -> DataFrame:
    """Each object a row.  ``records`` is the way to the array in the
    document, as ``data.items`` or ``batches[1].rows``."""
    df = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return within(df, records)


def within(df: DataFrame, records: str | None) -> DataFrame:
    """The rows of a document's array."""
    steps = re.findall(r"([^.\[\]]+)|\[(\d+)\]", re.sub(r"^\$\.?|\[\*\]$", "", records or ""))
    if not steps:
        return df
    at = None
    for name, index in steps:
        at = F.col(f"`{name}`") if at is None else at[int(index)] if index else at[name]
    got = df.select(at.alias("r"))
    if isinstance(got.schema["r"].dataType, T.ArrayType):
        got = got.select(F.explode("r").alias("r"))
    return got.select("r.*")


def inline(spark: SparkSession, name: str, header: list[str], rows: list[list[str]], schema: dict | None = None) -> DataFrame:
    """A literal table: declared types, else NUMBER where all cells are
    numbers and STRING otherwise; an empty cell is NULL."""
    kinds = {n.lower(): t for n, t in declared(schema or {}).items()}
    types, columns = [], []
    for i, h in enumerate(header):
        cells = [r[i] for r in rows]
        kind = kinds.get(h.lower()) or ("NUMBER" if any(cells) and all(_NUMBER.fullmatch(c) for c in cells if c) else "STRING")
        values = [_cell(name, h, k, c, kind) for k, c in enumerate(cells, 1)]
        t = spark_type(kind)
        if kind == "NUMBER" and all(v is None or v == v.to_integral_value() and abs(v) < 1 << 63 for v in values):
            t, values = T.LongType(), [None if v is None else int(v) for v in values]
        types.append(T.StructField(h, t))
        columns.append(values)
    return spark.createDataFrame([tuple(r) for r in zip(*columns)], T.StructType(types))


def _cell(name: str, column: str, row: int, text: str, kind):
    if text == "":
        return None
    try:
        if kind == "NUMBER":
            return Decimal(text)
        if kind == "BOOLEAN":
            return {"true": True, "1": True, "false": False, "0": False}[text.lower()]
        if kind == "DATE":
            return datetime.date.fromisoformat(text)
        if kind == "TIME":
            return datetime.time.fromisoformat(text).isoformat()
        if kind in ("TIMESTAMP", "TIMESTAMPTZ"):
            at = datetime.datetime.fromisoformat(text)
            zoned = at.replace(tzinfo=at.tzinfo or datetime.timezone.utc)
            return zoned if kind == "TIMESTAMP" else (zoned, int(zoned.utcoffset().total_seconds()))
        if kind == "DURATION":
            months, micros = durations.parse(text)
            if months:
                raise ValueError
            return datetime.timedelta(microseconds=micros)
    except (ValueError, KeyError, InvalidOperation, AlgebraError):
        raise AlgebraError(f"{name}.{column}, row {row}: {text!r} is not a {kind}, the type its schema declares") from None
    return text

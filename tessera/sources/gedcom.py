"""Genealogies in GEDCOM files: individuals and families.

A record begins at a line of level 0.  Spark's text reader splits the file at
these lines, so records are parsed in parallel and no file is held whole.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lexer import AlgebraError
from tessera.sources.files import declared, spark_type

_EVENT = "struct<date: date, text: string, place: string>"
SCHEMAS = {
    "individuals": f"id string, name string, surname string, sex string, birth {_EVENT}, death {_EVENT}",
    "families": "id string, husband string, wife string, children array<string>",
}
# The months of the format.
MONTHS = {"JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12}
_LINE = re.compile(r"\s*(\d+)\s+(?:(@[^@]+@)\s+)?(\w+)(?: (.*))?")


def exact_day(text: str | None) -> datetime.date | None:
    """The date of text that names one day; None for ranges and the like."""
    m = re.fullmatch(r"\s*(\d{1,2}) ([A-Za-z]{3}) (\d{4})\s*", text or "")
    try:
        return datetime.date(int(m[3]), MONTHS[m[2].upper()], int(m[1])) if m else None
    except (KeyError, ValueError):
        return None


def _parsed(record: str) -> tuple[str, dict] | None:
    lines = [m.groups() for line in record.splitlines() if (m := _LINE.fullmatch(line.rstrip("\r")))]
    if not lines or lines[0][0] != "0" or not lines[0][1]:
        return None
    key, tag = lines[0][1].strip("@"), lines[0][2]
    plain = lambda x: x.strip("@ ") if x else None
    if tag == "INDI":
        out: dict = {"id": key, "name": None, "surname": None, "sex": None, "birth": None, "death": None}
        event = None
        for level, _, t, value in lines[1:]:
            if level == "1":
                event = {"BIRT": "birth", "DEAT": "death"}.get(t)
                if event:
                    event = event if out[event] is None else None
                    if event:
                        out[event] = {"date": None, "text": None, "place": None}
                elif t == "NAME" and out["name"] is None and value:
                    out["name"] = " ".join(value.replace("/", " ").split())
                    inside = re.search(r"/([^/]*)/", value)
                    out["surname"] = inside[1].strip() or None if inside else None
                elif t == "SEX":
                    out["sex"] = value
            elif level == "2" and t == "SURN" and value:
                out["surname"] = value.strip()
            elif level == "2" and event and t == "DATE":
                out[event] |= {"text": value, "date": exact_day(value)}
            elif level == "2" and event and t == "PLAC":
                out[event]["place"] = value
        return "individuals", out
    if tag == "FAM":
        of = lambda t: [plain(v) for level, _, x, v in lines[1:] if level == "1" and x == t]
        return "families", {"id": key, "husband": next(iter(of("HUSB")), None), "wife": next(iter(of("WIFE")), None), "children": of("CHIL")}
    return None


def read(spark: SparkSession, options: dict, table: str, schema: dict | None) -> DataFrame:
    if table not in SCHEMAS:
        raise AlgebraError(f"a genealogy has individuals and families, no {table!r}")
    path = options.get("path") or options.get("url", "").removeprefix("file:")
    names = [x.split()[0] for x in ("id name surname sex birth death" if table == "individuals" else "id husband wife children").split()]

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [p[1] for text in batch.column(0).to_pylist() if (p := _parsed("0" + text if not text.startswith("0") else text)) and p[0] == table]
            yield pa.RecordBatch.from_pylist(found, schema=arrow) if found else pa.RecordBatch.from_pylist([], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMAS[table]))
    df = spark.read.option("lineSep", "\n0").text(path).mapInArrow(parse, SCHEMAS[table])
    if not schema:
        return df
    return df.select(*[_narrowed(df, n, k).alias(n) for n, k in declared(schema).items()]) if schema else df.select(*names)


def _narrowed(df: DataFrame, name: str, kind):
    """A column as declared, at every level; what the file lacks is NULL."""
    found = next((c for c in df.columns if c.lower() == name.lower()), None)
    if found is None:
        return F.lit(None).cast(spark_type(kind))
    if isinstance(kind, dict):
        have = {f.name.lower(): f.name for f in df.schema[found].dataType.fields}
        fields = [(F.col(found)[have[n.lower()]] if n.lower() in have else F.lit(None)).cast(spark_type(t)).alias(n) for n, t in kind.items()]
        return F.when(F.col(found).isNotNull(), F.struct(*fields))
    return F.col(found).cast(spark_type(kind))

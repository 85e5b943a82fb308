"""Access logs of web servers as typed relations.

A format is compiled to one regular expression with a group for each field;
lines are read as text and taken apart by it, inside Spark's own engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lexer import AlgebraError
from tessera.sources.files import converted, declared, spark_type

# The directives of the two servers' formats and their columns.
COMMON = '%h %l %u %t "%r" %>s %b'
COMBINED = COMMON + ' "%{Referer}i" "%{User-Agent}i"'
APACHE = {"%h": "host", "%a": "address", "%l": "ident", "%u": "user", "%t": "at", "%r": "request", "%m": "method", "%U": "path", "%q": "query", "%H": "protocol", "%>s": "status", "%s": "status", "%b": "bytes", "%B": "bytes", "%D": "duration_us", "%T": "duration_s", "%v": "server"}
NGINX = {"$remote_addr": "host", "$remote_user": "user", "$time_local": "at", "$time_iso8601": "at", "$request": "request", "$request_method": "method", "$request_uri": "path", "$server_protocol": "protocol", "$status": "status", "$body_bytes_sent": "bytes", "$bytes_sent": "bytes_sent", "$request_time": "duration_s", "$host": "server"}
NUMBERS = {"status", "bytes", "bytes_sent", "duration_us", "duration_s"}


def compiled(fmt: str) -> tuple[str, list[str]]:
    """A pattern for whole lines, and the field of each of its groups."""
    fmt = {"common": COMMON, "combined": COMBINED}.get(fmt.lower(), fmt)
    apache, nginx = bool(re.search(r"%[>{a-zA-Z]", fmt)), bool(re.search(r"\$\w", fmt))
    if apache == nginx:
        raise AlgebraError("a log format uses the directives of one server" if apache else "a log format without directives")
    token = re.compile(r"%\{([^}]+)\}i|%>?[a-zA-Z]" if apache else r"\$(http_)?\w+")
    pattern, fields, at = "", [], 0
    for m in token.finditer(fmt):
        pattern += re.escape(fmt[at : m.start()])
        at = m.end()
        if apache and m[1]:
            field = "agent" if m[1].lower() == "user-agent" else m[1].lower().replace("-", "_")
        elif not apache and m[1]:
            field = m[0][len("$http_") :]
            field = "agent" if field == "user_agent" else field
        else:
            field = (APACHE if apache else NGINX).get(m[0])
        if field is None:
            raise AlgebraError(f"a log format with {m[0]}, which is not read here")
        after = fmt[at : at + 1]
        if field == "at":
            pattern += r"\[([^\]]*)\]" if apache else r"([^\]\s]+(?: [+-]\d{4})?)"
        elif after == '"':
            pattern += r'((?:[^"\\]|\\.)*)'
        else:
            pattern += r"(\S*)"
        fields.append(field)
    return "^" + pattern + re.escape(fmt[at:]) + "$", fields


def _stamp(text):
    local = F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.coalesce(local, F.try_to_timestamp(text))


def read(spark: SparkSession, options: dict, table: str | None, schema: dict | None) -> DataFrame:
    """Of a connection; ``table`` names the file where its path is a folder.
    ``-`` is NULL; a line that does not fit is an error, or left out with
    ``onError: "skip"``."""
    path = options.get("path") or options.get("url", "").removeprefix("file:")
    if not path:
        raise AlgebraError("a log connection has a path")
    if table and path.rstrip("/").rsplit("/", 1)[-1] != table:
        path = f"{path.rstrip('/')}/{table}"
    pattern, fields = compiled(options.get("format", "common"))
    skip = (options.get("onError") or options.get("onerror") or "refuse") == "skip"
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    fits = F.col("value").rlike(pattern)
    if skip:
        lines = lines.where(fits)
    else:
        lines = lines.withColumn("value", F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a line that the log format does not match: "), F.col("value"))).cast("string")))
    texts: dict = {}
    for i, field in enumerate(fields, 1):
        text = F.nullif(F.regexp_extract("value", pattern, i), F.lit("-"))
        if field == "request":
            parts = F.split(text, " ")
            texts |= {"method": F.get(parts, F.lit(0)), "path": F.get(parts, F.lit(1)), "protocol": F.get(parts, F.lit(2))}
        else:
            texts[field] = text
    typed = lambda f: _stamp(texts[f]) if f == "at" else texts[f].cast("decimal(38,10)" if f == "duration_s" else "bigint") if f in NUMBERS else texts[f]
    if not schema:
        return lines.select(*[typed(f).alias(f) for f in texts])
    out = []
    for name, kind in declared(schema).items():
        f = next((f for f in texts if f.lower() == name.lower()), None)
        if f is None:
            out.append(F.lit(None).cast(spark_type(kind)).alias(name))
        elif f == "at" and kind == "TIMESTAMP" or f in NUMBERS and kind == "NUMBER":
            out.append(typed(f).alias(name))
        else:
            out.append(converted(texts[f], kind).alias(name))
    return lines.select(*out)

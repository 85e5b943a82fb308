"""JSON and CSV over HTTP as a Spark data source, a partition a page.

Only reads are sent: GET, QUERY and POST with a body.  Equality filters on
input columns and limits become request parameters.
"""

from __future__ import annotations

import base64
import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.plans.lexer import AlgebraError
from tessera.sources.files import converted, spark_type

METHODS = ("GET", "POST", "QUERY")
OWN_HEADERS = ("connection", "content-length", "expect", "host", "upgrade")


def checked(options: dict) -> dict:
    """The request that a declaration describes: url, method, headers, body,
    records, pages."""
    if "url" not in options:
        raise AlgebraError("an http source has a url")
    method = str(options.get("method", "GET")).upper()
    if method not in METHODS:
        raise AlgebraError(f"{method} is no read: use GET, POST or QUERY")
    if method == "QUERY" and "body" not in options:
        raise AlgebraError("QUERY needs a body")
    headers, params = dict(options.get("headers") or {}), {}
    auth = options.get("auth")
    added = {}
    if auth:
        kind, *args = auth
        if kind == "bearer":
            added["Authorization"] = f"Bearer {args[0]}"
        elif kind == "basic":
            added["Authorization"] = "Basic " + base64.b64encode(":".join(args).encode()).decode()
        elif kind == "apikey" and args[0] == "query":
            params[args[1]] = args[2]
        elif kind == "apikey":
            added[args[0]] = args[1]
        else:
            raise AlgebraError(f"no way to authorize {kind}")
    for h in added:
        if h.lower() in {x.lower() for x in headers}:
            raise AlgebraError(f"the header {h} is set in two places")
    headers |= added
    for h, v in headers.items():
        if h.lower() in OWN_HEADERS or not re.fullmatch(r"[!#$%&'*+.^_`|~\w-]+", h) or "\n" in v or "\r" in v:
            raise AlgebraError(f"the header {h} cannot be declared")
    if options.get("body") is not None and "content-type" not in {x.lower() for x in headers}:
        headers["Content-Type"] = "application/json"
    pages = options.get("paginate") or {}
    for name, (key, default) in pages.items():
        if default is not None:
            params.setdefault(key, str(default))
    extract = options.get("extract") or ("json", None)
    return {"url": options["url"], "method": method, "headers": headers, "params": params, "body": options.get("body"), "kind": extract[0], "where": extract[1], "pages": {k: list(v) for k, v in pages.items()}}


def fetch(request: dict, params: dict | None = None) -> list[dict]:
    """The records of one answer."""
    given = {**request["params"], **(params or {})}
    url = re.sub(r"(?<!\$)\{(\w+)\}", lambda m: urllib.parse.quote(str(given.pop(m[1], m[0]))), request["url"])
    if given:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(given)
    body = request["body"].encode() if request["body"] is not None else None
    ask = urllib.request.Request(url, data=body, headers={"Accept-Encoding": "gzip", **request["headers"]}, method=request["method"])
    try:
        with urllib.request.urlopen(ask, timeout=60) as answer:
            raw, status = answer.read(), answer.status
            coding, charset = answer.headers.get("Content-Encoding", ""), answer.headers.get_content_charset() or "utf-8"
    except (urllib.error.URLError, OSError) as e:
        raise RuntimeError(f"{request['url']}: {e}") from e
    if status == 204 or not raw:
        return []
    if coding == "gzip":
        import gzip

        raw = gzip.decompress(raw)
    elif coding == "deflate":
        import zlib

        raw = zlib.decompress(raw)
    text = raw.decode(charset).removeprefix("﻿")
    if request["kind"] == "csv":
        import csv
        import io

        rows = list(csv.reader(io.StringIO(text)))
        if request["where"] is False:
            return [{f"c{i + 1}": v or None for i, v in enumerate(r)} for r in rows]
        return [dict(zip(rows[0], [v or None for v in r])) for r in rows[1:]] if rows else []
    found = at(json.loads(text), request["where"])
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else [found] if isinstance(found, dict) else []


def at(value, path: str | None):
    """What stands at a path such as ``$.a.b[0]`` or ``$['a.b']``."""
    for name, quoted, index in re.findall(r"([^.\[\]$]+)|\['([^']*)'\]|\[(\d+)\]", re.sub(r"\[\*\]$", "", path or "")):
        if index:
            value = value[int(index)] if isinstance(value, list) and int(index) < len(value) else None
        else:
            value = value.get(name or quoted) if isinstance(value, dict) else None
    return value


class _Page(InputPartition):
    def __init__(self, params: dict):
        super().__init__(0)
        self.params = params


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.request = json.loads(options["request"])
        self.pages = json.loads(options.get("pages", "[{}]"))

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.pages]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for record in fetch(self.request, partition.params):
            yield (json.dumps(record),)


class HttpSource(DataSource):
    """One column ``record``: JSON text."""

    @classmethod
    def name(cls) -> str:
        return "tessera_http"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> HttpReader:
        return HttpReader(dict(self.options))


def document(records: str, columns: dict[str, str]) -> str:
    """A GraphQL query for the columns (name: path) of the records."""
    tree: dict = {}
    root = [x for x in re.findall(r"[A-Za-z_]\w*", re.sub(r"\[\*\]$", "", records))]
    for path in columns.values():
        at = tree
        for name in (root[1:] if root[:1] == ["data"] else root) + re.findall(r"[A-Za-z_]\w*", path):
            at = at.setdefault(name, {})

    def show(t: dict) -> str:
        return "{ " + " ".join(k + (f" {show(v)}" if v else "") for k, v in t.items()) + " }"

    return json.dumps({"query": show(tree)})


def read(spark: SparkSession, options: dict, inputs: dict | None = None, pages: list[dict] | None = None, limit: int | None = None, columns: set[str] | None = None) -> DataFrame:
    """``inputs`` are values of input columns; ``pages`` lists what each
    request adds to its parameters (one request if it is not given);
    ``limit`` and ``columns`` are all that the query can use."""
    request = checked(options)
    schema = options.get("schema") or {}
    if limit is not None and "limit" in request["pages"]:
        request["params"][request["pages"]["limit"][0]] = str(limit)
    if request["method"] == "POST" and request["body"] is None and request["where"] and schema:
        wanted = {n: (c.get("at") or n).removeprefix("$") for n, c in schema.items() if c["way"] == "out" and (columns is None or n.lower() in columns)}
        request["body"] = document(request["where"], wanted or {n: n for n, c in schema.items() if c["way"] == "out"})
        request["headers"].setdefault("Content-Type", "application/json")
    for name, col in schema.items():
        if col["way"] != "in":
            continue
        value = (inputs or {}).get(name, col.get("default"))
        if value is None:
            if col.get("required"):
                raise AlgebraError(f"the request needs a value for {name}")
            continue
        if col.get("as") == "header":
            request["headers"][col["key"]] = str(value)
        else:
            request["params"][col.get("key", name)] = str(value)
    spark.dataSource.register(HttpSource)
    df = spark.read.format("tessera_http").option("request", json.dumps(request)).option("pages", json.dumps(pages or [{}])).load()
    outs = {n: c for n, c in schema.items() if c["way"] == "out"}
    if not outs:
        # the records say which columns there are
        found = df.agg(F.schema_of_variant_agg(F.parse_json("record"))).first()[0]
        kinds = re.sub(r"\bOBJECT<", "STRUCT<", found).replace("VOID", "STRING") if found.startswith("OBJECT<") else "STRUCT<>"
        return df.select(F.from_json("record", kinds).alias("r")).select("r.*")
    cols = []
    for name, col in outs.items():
        path = col.get("at") or f"$['{name}']"
        text = F.get_json_object("record", path if path.startswith("$") else f"$.{path}")
        kind = col["type"]
        cols.append((F.from_json(text, spark_type(kind)) if not isinstance(kind, str) else converted(text, kind)).alias(name))
    got = [F.lit(str((inputs or {}).get(n, c.get("default")))).cast(spark_type(c["type"])).alias(n) for n, c in schema.items() if c["way"] == "in"]
    return df.select(*cols, *got)

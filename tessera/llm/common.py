"""What the text operators share: reading tables and mapping whole texts."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.components import cut
from tessera.operators.windows import Ranges
from tessera.plans.scope import Scope

#: Characters of text that one call of a batch function handles at most,
#: unless a single text is longer (a text is never cut).
CHUNK_CHARS = 6_000_000


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package even where the driver
    found it through ``sys.path`` alone."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), home) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def by_number(df: DataFrame, name: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on whole-number ids.  Ids of another type are numbered in
    their order first, and put back in ``name`` and ``component_id`` of what
    ``run`` gives; null ids stay null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return run(df)
    ids = Ranges(Scope(df.select(F.col(f"`{name}`").alias("__id")).where("__id is not null").distinct(), ()), [F.col("__id").asc()])
    number = cut(ids.joined().select("__id", (F.col("__ahead") + F.row_number().over(ids.local)).cast("bigint").alias("__no")))
    inner = df.join(number, F.col(f"`{name}`") == F.col("__id"), "left").drop("__id", name).withColumnRenamed("__no", name)
    out = run(inner)
    for c in (name, "component_id"):
        back = number.select(F.col("__id").alias("__back"), F.col("__no").alias("__at"))
        out = out.join(back, F.col(c) == F.col("__at"), "left").select(*[F.col("__back").alias(x) if x == c else F.col(x) for x in out.columns])
    return out


def map_texts(
    df: DataFrame,
    text: str,
    schema: str,
    run: Callable[[list[str], list[list]], list],
    keep: list[str],
    setup: Callable[[], object] | None = None,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Calls ``run(state, texts)`` on lists of whole texts; nulls read as
    the empty text.  ``run`` returns one list or Arrow array for each new
    column of ``schema`` (which names the kept columns first).

    Only ``keep`` and ``text`` reach Python.  Rows stay in their partitions:
    no shuffle.  ``setup`` runs once in a task.
    """
    names = [f.strip().split(" ", 1)[0] for f in _split(schema)]
    new = names[len(keep):]
    cols = [F.col(f"`{c}`") for c in keep] + [F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in _chunks(batch, chunk_chars):
                texts = part.column(part.num_columns - 1).to_pylist()
                made = run(state, texts)
                del texts
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=list(keep) + new)
                del made
        del state
        _give_back()

    return df.select(*cols).mapInArrow(go, schema)


def tidy(run: Callable) -> Callable:
    """A batch function that gives freed memory back when its task ends."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return go


def _give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def _split(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return out + [schema[at:]]


def _chunks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    yield batch.slice(at)

"""From raw documents to token ids: the stages, each on what the last kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the session's shared checkpoint folder and reads it
again for the next.  All but the last return the columns of ``docs``, whose
own names never meet those that an operator makes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, pii, simhash
from tessera.llm.common import table
from tessera.llm.queries import tokenizer
from tessera.operators.components import checkpoint_dir, drop


def _sealed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that no operator uses, and each column's."""
    names = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _opened(df: DataFrame, names: dict[str, str], **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col(inner)).alias(c) for c, inner in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: rejected are texts that are null or
    without a letter (``und``).  ``lang`` becomes the language found.

    Learns from the rows with a text and a language; where there are none,
    nothing is known and no document has a language.
    """
    inner, names = _sealed(docs)
    told = langid.identify(inner, langid.fit(docs), text=names["text"], keep=tuple(names.values()))
    return _opened(told.where("lang_pred <> 'und'"), names, lang=F.col("lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates, once.

    Rows repeated under one id are one document only if their texts are in
    that id's group: a text under the same id that is a near-duplicate of
    another document goes by itself.  Of an id's own texts the one with the
    least hash stays, of rows with that text the least by content.  Rows
    without an id can be told from no other; they stay as they are.
    """
    inner, names = _sealed(docs)
    of, text = names["doc_id"], names["text"]
    inner = inner.withColumn("__th", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    found = simhash.near_duplicates(inner, text=text, doc_id=of, keep=("__th",))
    keep = found.where("doc_id = component_id").groupBy(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias(of)).agg(F.min("__th").alias("__th"))
    rest = [c for c in inner.columns if c not in (of, "__th")]
    one = inner.join(keep, [of, "__th"], "left_semi").groupBy(of, "__th").agg(F.min(F.struct(*rest)).alias("__r"))
    out = one.select(of, *[F.col(f"__r.{c}").alias(c) for c in rest]).union(inner.where(F.col(of).isNull()).select(of, *rest))
    return _opened(out, names)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document with a word in a window of a benchmark item: a
    passage in a long text teaches the answer as well as one in a short
    text.  Documents without words stay."""
    inner, names = _sealed(docs)
    scanned = decontaminate.scan(inner, table(spark, sf_dir, "benchmark"), text=names["text"], keep=tuple(names.values()))
    return _opened(scanned.where(F.size("hit") == 0), names)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of personal data; keeps all rows
    (a null text becomes empty) and sets ``n_chars``, if there, anew."""
    inner, names = _sealed(docs)
    found = pii.detect(inner, pii.trained(), text=names["text"], keep=tuple(v for c, v in names.items() if c != "text"), redacted=True)
    anew = {"n_chars": F.length("redacted").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _opened(found, names, text=F.col("redacted"), **anew)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it again, beside
    the document's id, language, source and length, as far as it has them."""
    inner, names = _sealed(docs)
    beside = [c for c in ("doc_id", "lang", "source", "n_chars") if c in names]
    coded = bpe.encode(inner, *tokenizer(), text=names["text"], keep=tuple(names[c] for c in (*beside, "text")))
    same = F.coalesce(F.col("decoded") == F.coalesce(F.col(names["text"]), F.lit("")).cast("binary"), F.lit(False))
    return coded.select(*[F.col(names[c]).alias(c) for c in beside], "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", contamination),
    ("pii", personal_data),
    ("byte_bpe", tokens),
]

#: Trained models and hashed fingerprints are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        if k:  # the last stage's input is read no more
            drop(spark, f"{base}/{k - 1}_{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs

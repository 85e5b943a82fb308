"""The registered queries of this package, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, extract, langid, pii, simhash, substring, toxicity, vectors
from tessera.llm.common import ready, table


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _part(of: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_part(4) == 2, F.lit(False)))
    model = toxicity.fit(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents"), pii.trained()))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), *tokenizer())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_part(3) == 1, F.lit(False)))
    profile = langid.fit(docs.where("not held_out"))
    return langid.identify(docs, profile, keep=("doc_id", "held_out"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-1L, 0, 'user', '</s>[INST] ok [/INST]'), (-1L, 1, 'assistant', '</s>[INST] ok [/INST]') AS own(conv_id, turn, role, text)")
    return chat.read_back(chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; the others (a byte-pair
    encoding, XXH64 with a seed, trained models) are tested against
    brute-force versions and held-out rows."""
    return {"op3_substring_dedup": OP3_SQL, "op5_embedding_dedup": OP5_SQL, "op9_decontamination": OP9_SQL, "op10_chat_format": OP10_SQL}


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
win AS (SELECT r, doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
least_ AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
cover AS (SELECT r, p FROM win JOIN least_ USING (k) WHERE doc_id > lo),
marked AS (SELECT w.r, w.p, word, coalesce(max(cover.p) OVER (PARTITION BY w.r ORDER BY w.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM w LEFT JOIN cover ON w.r = cover.r AND w.p = cover.p),
kept AS (SELECT r, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(b) AS lo FROM c GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, m.lo) AS component_id, coalesce(vec_id = least(vec_id, m.lo), false) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(13, len(w)) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT r, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(w) >= n)),
f AS (SELECT r, p, n, item_id FROM dw JOIN iw USING (n, k)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM f)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM f) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

# A backslash goes behind the bracket of every control string in a role or a
# text, and of every string that is one but for backslashes there; the marks
# of a turn take 20 characters.
OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*/?(s>|INST\])')) + 20 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

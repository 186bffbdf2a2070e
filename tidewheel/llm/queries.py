"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bm25, langid, line_dedup, mixing, packing, secrets, simhash, substring_dedup, token_files, vector_dedup
from tidewheel.llm.common import sha256_utf8


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    counts = [secrets.count_of(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, sha256_utf8(secrets.listed(base)).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(_documents(spark, sf_dir))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(_documents(spark, sf_dir), token_files.new_path(spark))
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    kept = substring_dedup.without(docs, substring_dedup.repeated_intervals(docs))
    return kept.select("doc_id", "n_words", "n_removed", sha256_utf8(F.col("kept")).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).taken()


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    asked = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return bm25.search(docs, asked).select("query_id", "rank", "doc_id", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    kept = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_utf8(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP5 = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50)),
owners AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN owners USING (h) WHERE doc_id > owner),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM texts)
SELECT texts.doc_id, CAST(len(any_value(texts.words)) AS BIGINT) AS n_words, count(gone.k) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY placed.k) FILTER (gone.k IS NULL), '')) AS kept_sha256
FROM texts LEFT JOIN placed USING (doc_id) LEFT JOIN gone ON gone.doc_id = placed.doc_id AND gone.k = placed.k
GROUP BY texts.doc_id
"""

OP7 = r"""
WITH words AS (
  SELECT doc_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS dl FROM counts GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM lengths) / (SELECT count(*) FROM documents) AS mean),
weights AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM counts, total GROUP BY term, n),
scores AS (
  SELECT q.doc_id AS query_id, c.doc_id, round(sum(q.tf * idf * c.tf * 2.2 / (c.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM counts q JOIN counts c USING (term) JOIN weights USING (term) JOIN lengths l ON l.doc_id = c.doc_id, total
  WHERE q.doc_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP8 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, largest IS NOT NULL AND doc_id <> largest AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (
  SELECT vec_id AS v, vec_id AS r FROM embeddings
  UNION SELECT v, b FROM reached JOIN links ON a = r),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v AS vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, v = min(r) AS kept
FROM reached LEFT JOIN counts ON a = v GROUP BY v
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_packing": op3_packing,
        "op4_token_files": op4_token_files,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_mixing": op6_mixing,
        "op7_top_k_search": op7_top_k_search,
        "op8_line_dedup": op8_line_dedup,
        "op9_language_id": op9_language_id,
        "op10_embedding_dedup": op10_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5, "op7_top_k_search": OP7, "op8_line_dedup": OP8, "op10_embedding_dedup": OP10}

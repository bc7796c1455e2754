"""Registered queries of this package: each applies its operator to the whole of its tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import table
from fairlead.llm.decontaminate import contaminated
from fairlead.llm.divergence import source_divergence
from fairlead.llm.language_mixture import identify_languages
from fairlead.llm.licenses import license_scan
from fairlead.llm.minhash import fingerprint_documents
from fairlead.llm.packing import pack_documents
from fairlead.llm.sharding import shard_documents
from fairlead.llm.simhash import simhash_components
from fairlead.llm.suffix_columns import remove_repeated_bytes
from fairlead.llm.superkmer import substring_dedup
from fairlead.llm.token_matrix import token_matrix
from fairlead.llm.toxicity import score_documents
from fairlead.llm.vector_codes import digest, encode_vectors

TOKENIZER = "byte_bpe_50k.json"
CAPACITY, END_ID, SHARDS = 1024, 2, 40

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), tokenizer(), CAPACITY, END_ID)


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = shard_documents(table(spark, folder, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_token_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return token_matrix(table(spark, folder, "documents"), tokenizer(), CAPACITY, END_ID)


@query
def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash_components(table(spark, folder, "documents"), 3, 42)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(table(spark, folder, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup(table(spark, folder, "documents"))
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"), 0.3)
    return scored.select("row.doc_id", "held_out", "score", "predicted", "worst_words")


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("row.doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = encode_vectors(table(spark, folder, "embeddings"), 8, 16, 6, 4096)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    sums = coded.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same_label"))).select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"), 3, 200)


ORACLE["op12_source_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + v.v) AS p
  FROM n JOIN v ON v.lang = n.lang JOIN kept k ON k.lang = n.lang
  LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.c + 1)) // (m.n + v.v) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term) l
  JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m ON m.lang = l.lang JOIN v ON v.lang = l.lang),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
term AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value,
    row_number() OVER (PARTITION BY lang, source ORDER BY coalesce(value, 0) DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    told = identify_languages(table(spark, folder, "documents"))
    return told.select("row.doc_id", "held_out", "lang_pred", "score", "mixture")

"""The corpus operators as queries over the given tables: op<N>_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, line_crf, mixing, page_diff, pieces, pii, prefix_trie, quality_rules, simhash, token_output, token_scan, warc
from .common import read_table


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return line_crf.classify(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.judge(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op4_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_diff.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(read_table(spark, sf_dir, "documents", "doc_id", "text")))


def op7_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count_documents(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_tokens")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    m = found.select("doc_id", "__mix.*")
    return m.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p", 6).alias("p"), "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN low END AS refers_to
FROM q
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontam.contained_items(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


OP10_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS s
  FROM words WHERE w IS NOT NULL),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 'b')
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n AS n_item, round(count(*) / n, 6) AS containment
FROM shingles d JOIN items i ON d.s = i.s AND d.side = 'd'
GROUP BY d.id, i.id, n HAVING count(*) / n >= 0.8
""".replace("\\\\", "\\")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op6_pii": pii.oracle_sql(), "op8_mixing": mixing.oracle_sql(), "op9_warc": OP9_SQL, "op10_decontamination": OP10_SQL}

"""Catalogue entries of answer assembly and evaluation helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import answers, chunking
from lexweave.session import table


def history_questions(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", answers.asks_history(F.col("query")).alias("asks_history"))


def evidence_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "title", F.col("source").alias("source_org"), F.col("published_on").alias("publish_date"), F.col("status").alias("legal_status"))
    header = answers.evidence_header(["title", "source_org", "publish_date", "legal_status"], F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return rows.select("doc_id", header.alias("header"))


def needle_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "citation_verdicts").select("verdict_id", "article").distinct()
    return rows.select("verdict_id", "article", F.array_join(answers.needles((F.col("article") * 1000).cast("string")), "/").alias("needles"))


def ground_truth_hits(spark, sf_dir):
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.array("target_doc").alias("doc_keys"), F.array("passage").alias("needles"))
    parents = table(spark, sf_dir, "legal_parent_contract_v1").select(F.split("document_identity", "@")[0].alias("doc_key"), "external_parent_id", F.col("content").alias("text")).dropDuplicates(["external_parent_id"])
    candidates = items.select("query_id", F.explode("doc_keys").alias("doc_key")).join(parents, "doc_key").withColumn("rank", F.lit(1)).drop("external_parent_id")
    return answers.ground_truth_hits(candidates, items).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hits"))


def determinism_gate(spark, sf_dir):
    run = lambda: chunking.with_chunk_ids(chunking.child_windows(table(spark, sf_dir, "documents"))).select("doc_id", "chunk_id")
    return answers.differs(run(), run()).agg(F.count("*").alias("n_differing"))


QUERIES = {f.__name__: f for f in (history_questions, evidence_headers, needle_variants, ground_truth_hits, determinism_gate)}

_HISTORY = "|".join(f"(?:{p})" for p in answers.HISTORY)
SQL = {
    "history_questions": f"SELECT item_id, length(trim(query)) >= 2 AND regexp_matches(query, '{_HISTORY}') AS asks_history FROM eval_items",
    "evidence_headers": """SELECT doc_id, concat_ws(chr(10), '[Source Metadata]', CASE WHEN title <> '' THEN 'title: ' || title END, CASE WHEN source <> '' THEN 'source_org: ' || source END, CASE WHEN published_on <> '' THEN 'publish_date: ' || published_on END,
CASE WHEN status <> '' THEN 'legal_status: ' || status END, 'source_file: doc_' || doc_id || '.txt') AS header FROM documents""",
    "needle_variants": "SELECT DISTINCT verdict_id, article, format('{:,}', article::BIGINT * 1000) || '元/' || format('{:,}', article::BIGINT * 1000) || '/' || (article::BIGINT * 1000) AS needles FROM citation_verdicts",
    "ground_truth_hits": """WITH p AS (SELECT string_split(document_identity, '@')[1] AS k, external_parent_id, any_value(content) AS content FROM legal_parent_contract_v1 GROUP BY 1, 2)
SELECT item_id AS query_id, count(*) AS n, count(*) FILTER (contains(lower(content), lower(passage))) AS n_hits FROM eval_items JOIN p ON k = target_doc GROUP BY 1""",
    "determinism_gate": "SELECT 0::BIGINT AS n_differing",
}

"""Queries of the subpackage, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.boilerplate import main_blocks
from lexweave.llm.leakage import leaked_passages
from lexweave.llm.lookalikes import consistent_texts, needed_repair, suspect_texts
from lexweave.llm.neardup import alike_pairs, duplicate_classes
from lexweave.llm.packing import pack_documents, packing_checks, packing_summary
from lexweave.llm.repeated_lines import PLAIN, WIDE, cleaned_documents, repeated_blocks
from lexweave.llm.sentences import split_sentences
from lexweave.llm.splitting import distinct_pieces, oversized, split_items
from lexweave.session import materialize, spread, table


def limit_of(spark: SparkSession, sf_dir: str, kind: str) -> tuple[int, int]:
    """``max_size`` and ``overlap_size`` of an item kind."""
    row = table(spark, sf_dir, "size_limits").where(f"item_kind = '{kind}'").first()
    return row["max_size"], row["overlap_size"]


def p2_main_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_blocks(table(spark, sf_dir, "page_candidates"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_main_blocks(spark, sf_dir).select("page_id", "candidate_no")


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "legal_parent_contract_v1").select(F.col("external_parent_id").alias("record_id"), F.col("content").alias("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(_parents(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(_parents(spark, sf_dir))


def _sized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "legal_parent_contract_v1").select(F.lit("parent").alias("item_kind"), F.col("external_parent_id").alias("item_id"), "content")
    children = table(spark, sf_dir, "legal_child_v2").select(F.lit("child").alias("item_kind"), F.col("child_id").alias("item_id"), "content")
    return parents.unionByName(children)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(split_items(_sized_items(spark, sf_dir), table(spark, sf_dir, "size_limits")))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_pieces(split_items(_sized_items(spark, sf_dir), table(spark, sf_dir, "size_limits")))


def _texts_and_vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parents = table(spark, sf_dir, "legal_parent_contract_v1").select(F.lit("parent").alias("item_kind"), F.col("external_parent_id").alias("item_id"), F.col("content").alias("text"))
    verdicts = table(spark, sf_dir, "citation_verdicts").select(F.lit("verdict").alias("item_kind"), F.col("verdict_id").cast("string").alias("item_id"), F.col("law").alias("text"))
    items = parents.unionByName(verdicts)
    return items, items.select("text").unionByName(table(spark, sf_dir, "law_titles").select(F.col("title").alias("text")))


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_texts(*_texts_and_vocabulary(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = materialize(suspect_texts(*_texts_and_vocabulary(spark, sf_dir)))
    titles = table(spark, sf_dir, "law_titles").select("title").distinct()
    parents = texts.filter((F.col("item_kind") == "parent") & needed_repair()).select("item_kind", "item_id")
    laws = texts.filter((F.col("item_kind") == "verdict") & (F.col("text") != F.col("consistent")))
    same = laws.join(titles, F.col("consistent") == F.col("title"), "left_semi").join(titles, F.col("text") == F.col("title"), "left_anti")
    return parents.unionByName(same.select("item_kind", "item_id")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_blocks(table(spark, sf_dir, "block_decisions"), table(spark, sf_dir, "duplicate_groups"))


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_documents(table(spark, sf_dir, "block_decisions"), table(spark, sf_dir, "duplicate_groups"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir).select("doc_id", "text"), limit_of(spark, sf_dir, "document")[0])


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_summary(p7_containers(spark, sf_dir), limit_of(spark, sf_dir, "document")[0])


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = materialize(p7_containers(spark, sf_dir))  # read four times
    return packing_checks(packed, table(spark, sf_dir, "documents"), limit_of(spark, sf_dir, "document")[0])


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(_documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_coverage(spark, sf_dir).select("item_id", "doc_id")


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(_documents(spark, sf_dir).select("doc_id", "text", "layout"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_sentences(spark, sf_dir).select("doc_id", "sent_end")


QUERIES = {
    "p2_found": p2_found,
    "p2_main_blocks": p2_main_blocks,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p6_found": p6_found,
    "p6_documents": p6_documents,
    "p7_containers": p7_containers,
    "p7_summary": p7_summary,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_coverage": p8_coverage,
    "p9_found": p9_found,
    "p9_sentences": p9_sentences,
}

_LINES = """
WITH listed AS (
  SELECT document_identity, o AS original_block_order, min(normalized_text) AS t
  FROM (SELECT document_identity, unnest(block_orders) AS o, normalized_text FROM duplicate_groups WHERE normalized_text IS NOT NULL) GROUP BY 1, 2),
raw AS (
  SELECT source_site, b.document_identity, b.original_block_order, coalesce(text_preview, t) AS line
  FROM block_decisions b LEFT JOIN listed l ON l.document_identity = b.document_identity AND l.original_block_order = b.original_block_order
  WHERE b.document_identity IS NOT NULL),
lines AS (
  SELECT DISTINCT source_site, document_identity, original_block_order,
    regexp_replace(regexp_replace(lower(translate(line, '{wide}', '{plain}')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'), '\\p{{Nd}}+', '0', 'g') AS k
  FROM raw WHERE line IS NOT NULL),
sizes AS (SELECT source_site, count(DISTINCT document_identity) AS n FROM block_decisions GROUP BY 1),
often AS (
  SELECT l.source_site, k FROM lines l JOIN sizes s ON s.source_site IS NOT DISTINCT FROM l.source_site
  WHERE k <> '' GROUP BY l.source_site, k, s.n HAVING count(DISTINCT document_identity) >= 3 AND count(DISTINCT document_identity) * 5 >= s.n),
gone AS (
  SELECT DISTINCT document_identity, original_block_order FROM lines l JOIN often f ON f.k = l.k AND f.source_site IS NOT DISTINCT FROM l.source_site)
""".format(wide=WIDE.replace("'", "''"), plain=PLAIN.replace("'", "''"))

SQL: dict[str, str] = {
    "p4_found": """
SELECT DISTINCT 'parent' AS item_kind, external_parent_id AS item_id FROM legal_parent_contract_v1
WHERE length(content) > (SELECT max_size FROM size_limits WHERE item_kind = 'parent')
UNION ALL
SELECT DISTINCT 'child', child_id FROM legal_child_v2 WHERE length(content) > (SELECT max_size FROM size_limits WHERE item_kind = 'child')""",
    "p7_checks": """
SELECT 'documents' AS check_name, count(DISTINCT doc_id) AS n FROM documents
UNION ALL SELECT unnest(['broken_documents', 'oversized_pieces', 'containers_over', 'windows_over', 'mixed_containers', 'much_unused', 'unbalanced_steps', 'lost_documents']), 0""",
    "p6_found": _LINES + "SELECT * FROM gone",
    "p6_documents": _LINES + """
, latest AS (
  SELECT document_identity, original_block_order, arg_max(text_preview, (decided_at, coalesce(text_preview, ''))) AS text_preview
  FROM (SELECT DISTINCT document_identity, original_block_order, decided_at, text_preview FROM block_decisions) GROUP BY 1, 2)
SELECT a.document_identity, count(*) FILTER (g.document_identity IS NULL) AS n_kept, count(g.document_identity) AS n_removed,
  coalesce(string_agg(coalesce(text_preview, t), chr(10) ORDER BY a.original_block_order) FILTER (g.document_identity IS NULL), '') AS text
FROM latest a
LEFT JOIN listed l ON l.document_identity = a.document_identity AND l.original_block_order = a.original_block_order
LEFT JOIN gone g ON g.document_identity = a.document_identity AND g.original_block_order = a.original_block_order
GROUP BY 1""",
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL

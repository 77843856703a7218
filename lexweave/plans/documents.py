"""Catalogue entries over document texts: normalising, cleaning, windows, statistics, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import SPACE, document_identity, normalize_ws, search_tokens, strip
from lexweave.operators import chunking, cleaning
from lexweave.session import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def doc_normalize_ws(spark, sf_dir):
    t = normalize_ws("text")
    return documents(spark, sf_dir).select("doc_id", F.length(t).alias("n_chars_normalized"), F.sha2(t, 256).alias("sha256"))


def doc_line_counts(spark, sf_dir):
    lines = F.split("text", "\n")
    return documents(spark, sf_dir).select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: strip(x) == "")).alias("n_blank"), F.array_max(F.transform(lines, F.length)).alias("longest"))


def doc_exact_duplicates(spark, sf_dir):
    groups = documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_doc_id"))
    return groups.filter(F.col("n_copies") > 1)


def doc_identities(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", document_identity(F.format_string("DOC_%06d", F.col("doc_id")), F.lit(".txt"), F.sha2("text", 256)).alias("identity"))


def repeated_lines_corpus(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", strip("line").alias("line")).filter(F.col("line") != "")
    return lines.distinct().groupBy("line").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= 3)


def cleaned_documents(spark, sf_dir):
    return cleaning.clean_documents(documents(spark, sf_dir)).drop("clean_text")


def line_actions(spark, sf_dir):
    return cleaning.classify_lines(documents(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_documents"))


def _pages(spark, sf_dir):
    parents = table(spark, sf_dir, "legal_parent_contract_v1").select("document_identity", "external_parent_id", "content").distinct()
    lines = parents.select(F.col("document_identity").alias("doc_id"), F.col("external_parent_id").alias("page_no"), F.split("content", "\n").alias("ls"))
    return lines.select("doc_id", "page_no", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("line_no", "line"))


def repeated_boundaries(spark, sf_dir):
    return cleaning.repeated_boundaries(_pages(spark, sf_dir), share=0.05).select("doc_id", "side", F.col("position").cast("int").alias("position"), "line", "n_on", "n_pages")


def child_windows(spark, sf_dir):
    return chunking.child_windows(documents(spark, sf_dir)).select("doc_id", "chunk_index", "start", "end", F.sha2("content", 256).alias("sha256"), "is_tail")


def strategy_a_windows(spark, sf_dir):
    return chunking.child_windows(documents(spark, sf_dir), stop_at_end=True).select("doc_id", "chunk_index", "start", "end", F.length("content").alias("n_chars"))


def chunk_ids(spark, sf_dir):
    return chunking.with_chunk_ids(chunking.child_windows(documents(spark, sf_dir))).select("doc_id", "chunk_index", "chunk_id")


def _language(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("language", F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("none")))


def chunk_length_stats(spark, sf_dir):
    rows = _language(spark, sf_dir)
    return chunking.length_stats(chunking.child_windows(rows).join(rows.select("doc_id", "language"), "doc_id"), ["language"])


def chunk_rollup(spark, sf_dir):
    return chunking.weighted_rollup(chunk_length_stats(spark, sf_dir).withColumn("scope", F.lit("all")), ["scope"])


def chunk_coverage(spark, sf_dir):
    rows = documents(spark, sf_dir)
    lengths = rows.select("doc_id", F.length(normalize_ws("text")).alias("n")).filter(F.col("n") > 0)
    return chunking.coverage(chunking.child_windows(rows), lengths)


def shingle_duplicate_ratio(spark, sf_dir):
    return chunking.duplicate_ratio(documents(spark, sf_dir))


def token_document_frequency(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(search_tokens("text"))).alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("df"))


def source_rollup(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.lower("source").alias("source"), "category", "status", F.length("text").alias("n"))
    return rows.rollup("category", "status").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_chars"), F.count_distinct("source").alias("n_sources"), F.grouping_id().cast("int").alias("level"))


QUERIES = {f.__name__: f for f in (doc_normalize_ws, doc_line_counts, doc_exact_duplicates, doc_identities, repeated_lines_corpus, cleaned_documents, line_actions, repeated_boundaries, child_windows, strategy_a_windows, chunk_ids, chunk_length_stats, chunk_rollup, chunk_coverage, shingle_duplicate_ratio, token_document_frequency, source_rollup)}


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def norm_sql(x: str) -> str:
    inner = rf"regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')"
    return strip_sql(rf"regexp_replace({inner}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _windows(last: str) -> str:
    return f"""
t AS (SELECT doc_id, {norm_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, t, length(t) AS n, unnest(generate_series(0, CASE WHEN length(t) <= 512 THEN 0 ELSE {last} END, 384)) AS start FROM t WHERE length(t) > 0),
w AS (SELECT doc_id, start // 384 AS chunk_index, start, least(start + 512, n) AS "end", substr(t, start + 1, 512) AS content, n FROM s),
c AS (SELECT *, "end" = n AND start > 0 AS is_tail FROM w WHERE length({strip_sql('content')}) > 0)
"""


_ALL = _windows("((length(t) - 1) // 384) * 384")
_STOP = _windows("((length(t) - 512 + 383) // 384) * 384")
_STATS = f"""WITH {_ALL}, l AS (SELECT doc_id, coalesce(lower(substr(lang, 1, 2)), 'none') AS language FROM documents), st AS (
SELECT language, count(*) AS chunks, round(avg(length(content)), 4) AS avg_chars, round(quantile_cont(length(content), 0.5), 4) AS median_chars, round(quantile_cont(length(content), 0.95), 4) AS p95_chars,
  min(length(content))::INTEGER AS min_chars, max(length(content))::INTEGER AS max_chars, count(*) FILTER (length(content) > 1200) AS oversized, count(*) FILTER (length(content) < 64) AS very_small
FROM c JOIN l USING (doc_id) GROUP BY language)
"""

SQL = {
    "doc_normalize_ws": f"WITH t AS (SELECT doc_id, {norm_sql('text')} AS t FROM documents) SELECT doc_id, length(t)::INTEGER AS n_chars_normalized, sha256(t) AS sha256 FROM t",
    "doc_line_counts": f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, len(ls)::INTEGER AS n_lines, len(list_filter(ls, lambda x: {strip_sql('x')} = ''))::INTEGER AS n_blank, list_max(list_transform(ls, lambda x: length(x)))::INTEGER AS longest FROM l",
    "doc_exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n_copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "doc_identities": "SELECT doc_id, 'DOC_' || lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INTEGER, '0') || '.txt@sha256:' || sha256(text) AS identity FROM documents",
    "repeated_lines_corpus": f"WITH l AS (SELECT DISTINCT doc_id, {strip_sql('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT line, count(*) AS n_documents FROM l WHERE line <> '' GROUP BY 1 HAVING count(*) >= 3",
    "child_windows": f'WITH {_ALL} SELECT doc_id, chunk_index, start, "end", sha256(content) AS sha256, is_tail FROM c',
    "strategy_a_windows": f'WITH {_STOP} SELECT doc_id, chunk_index, start, "end", length(content)::INTEGER AS n_chars FROM c',
    "chunk_ids": f"""WITH {_ALL} SELECT doc_id, chunk_index, substr(sha256('CMCV1|' || sha256(content) || '|' || doc_id || '|' || chunk_index || '|' || start || '|' || "end"), 1, 32) AS chunk_id FROM c""",
    "chunk_length_stats": _STATS + "SELECT * FROM st",
    "chunk_rollup": _STATS + "SELECT 'all' AS scope, sum(chunks)::BIGINT AS total_chunks, round(sum(avg_chars * chunks) / sum(chunks), 4) AS avg_chars, round(sum(median_chars * chunks) / sum(chunks), 4) AS median_chars, round(sum(p95_chars * chunks) / sum(chunks), 4) AS p95_chars, min(min_chars) AS min_chars, max(max_chars) AS max_chars FROM st",
    "chunk_coverage": f"""WITH {_ALL}, k AS (SELECT doc_id, n, start, "end", coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT doc_id, round(100.0::DOUBLE * sum(greatest("end" - greatest(start, before), 0)) / any_value(n), 4) AS coverage_pct FROM k GROUP BY doc_id""",
    "shingle_duplicate_ratio": f"""
WITH t AS (SELECT doc_id, {norm_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, substr(t, i, 8) AS s FROM (SELECT doc_id, t, unnest(generate_series(1, length(t) - 7)) AS i FROM t WHERE length(t) >= 8)),
m AS (SELECT doc_id, s, count(*) AS m FROM g GROUP BY ALL),
r AS (SELECT doc_id, sum(CASE WHEN m > 1 THEN m ELSE 0 END) AS repeated FROM m GROUP BY 1)
SELECT t.doc_id, round(least(1.0::DOUBLE, coalesce(repeated, 0)::DOUBLE / length(t)), 6) AS duplicate_ratio FROM t LEFT JOIN r USING (doc_id) WHERE length(t) > 0""",
    "token_document_frequency": "SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[一-鿿]|[a-zA-Z]+|[0-9]+'))) AS term FROM documents) GROUP BY 1",
    "repeated_boundaries": f"""
WITH p AS (SELECT DISTINCT document_identity AS doc_id, external_parent_id AS page_no, content FROM legal_parent_contract_v1),
l AS (SELECT doc_id, page_no, len(ls) AS n_lines, unnest(generate_series(0, len(ls) - 1)) AS line_no, ls FROM (SELECT *, string_split(content, chr(10)) AS ls FROM p)),
q AS (SELECT doc_id, page_no, {strip_sql('ls[line_no + 1]')} AS line, CASE WHEN line_no < 3 THEN 'top' WHEN n_lines - line_no <= 3 THEN 'bottom' END AS side, CASE WHEN line_no < 3 THEN line_no ELSE n_lines - line_no - 1 END AS position FROM l),
n AS (SELECT doc_id, count(DISTINCT page_no) AS n_pages FROM p GROUP BY 1 HAVING count(DISTINCT page_no) >= 4),
k AS (SELECT doc_id, side, position, line, count(DISTINCT page_no) AS n_on FROM q WHERE side IS NOT NULL AND line <> '' GROUP BY ALL)
SELECT doc_id, side, position::INTEGER AS position, line, n_on, n_pages FROM k JOIN n USING (doc_id) WHERE n_on >= 0.05 * n_pages""",
    "source_rollup": "SELECT category, status, count(*) AS n_documents, sum(length(text))::BIGINT AS n_chars, count(DISTINCT lower(source)) AS n_sources, (grouping(category) * 2 + grouping(status))::INTEGER AS level FROM documents GROUP BY ROLLUP (category, status)",
}

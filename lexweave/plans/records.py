"""Catalogue entries of the record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import records, retrieval
from lexweave.session import spread, table


def _parents(spark, sf_dir):
    return table(spark, sf_dir, "legal_parent_contract_v1")


def identities_of_documents(spark, sf_dir):
    names = table(spark, sf_dir, "eval_items").select("target_doc")
    return records.of_documents(_parents(spark, sf_dir), names).groupBy("document_identity").agg(F.count("*").alias("n"))


def frequent_laws(spark, sf_dir):
    return records.frequent_values(table(spark, sf_dir, "citation_verdicts"), "law", 5)


def parent_metadata_keys(spark, sf_dir):
    rows = _parents(spark, sf_dir).select(F.explode(F.map_keys(records.without_keys("metadata", ("page", "lang")))).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"))


def inherited_quality_flags(spark, sf_dir):
    flagged = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("status").alias("qgate_status"), F.col("lang").alias("qg_lang"), F.col("title").alias("title"))).alias("m"))
    flags = records.quality_flags("m")
    return flagged.select("doc_id", F.array_join(F.array_sort(F.map_keys(flags)), ",").alias("flags"))


def mapped_parents(spark, sf_dir):
    rows = records.mapped_parents(table(spark, sf_dir, "legal_child_parent_map_v1"), _parents(spark, sf_dir))
    return rows.select("child_id", "external_parent_id", F.length("content").alias("n_chars"))


def headed_children(spark, sf_dir):
    manifest = _parents(spark, sf_dir).filter("created_at < timestamp_ntz '2024-07-01'").select("document_identity", F.concat(F.lit("title: "), F.substring_index("document_identity", "@", 1)).alias("header"))
    hits = table(spark, sf_dir, "legal_child_v2").select("child_id", "document_identity", F.col("content").alias("text")).distinct()
    return records.with_source_header(hits, manifest, "document_identity").select("child_id", F.sha2("text", 256).alias("sha256"))


def resolved_users(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("visitor_id"))
    known = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("visitor_id"), (F.col("c_custkey") + 1_000_000).alias("user_id"))
    return records.resolve_users(seen, known)


def orphan_chunk_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "block_decisions").select("source_site", F.col("text_preview").alias("content"), F.col("block_type").alias("kind"), F.regexp_count("text_preview", F.lit("第[一二三四五六七八九十百]+条")).alias("n_articles")).filter(F.col("content").isNotNull())
    return records.orphan_counts(rows, ["source_site"])


def listed_block_coverage(spark, sf_dir):
    blocks = table(spark, sf_dir, "block_decisions").select("document_identity", F.col("original_block_order").alias("block_order"))
    return records.block_coverage(table(spark, sf_dir, "duplicate_groups"), blocks)


def decision_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "citation_verdicts").select("verdict_id", "status").distinct()
    return records.totals(rows, "verdict_id", "status", ["article_missing", "law_not_in_evidence"])


def final_counts(spark, sf_dir):
    parents, mapping = _parents(spark, sf_dir), table(spark, sf_dir, "legal_child_parent_map_v1")
    actual = parents.agg(F.count("*").alias("rows"), F.count_distinct("document_identity").alias("identities")).crossJoin(mapping.agg(F.count("*").alias("map_rows")))  # one row each
    return records.against_expected(actual, {"rows": 612, "identities": 60, "map_rows": 0})


def question_distributions(spark, sf_dir):
    return records.distributions(table(spark, sf_dir, "eval_items"), ["query_type", "difficulty", "lang"])


def source_dictionary(spark, sf_dir):
    return records.value_dictionary(table(spark, sf_dir, "documents"), "source", "doc_id")


def lines_without_junk(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    told = lines.select("doc_id", "line_no", (F.length(F.trim("line")) < 12).alias("junk"), F.col("line").rlike("[0-9]").alias("separator")).withColumn("separator", ~F.col("junk") & F.col("separator"))
    return records.drop_separators_after_junk(told, ["doc_id"], "line_no").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("line_no").alias("line_sum"))


def interleaved_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").alias("y"), F.floor(F.col("l_discount") * 100).alias("x"), F.col("l_returnflag").alias("kind"))
    return records.interleave(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "place")


def answer_slices(spark, sf_dir):
    pieces = records.text_slices("passage")
    return table(spark, sf_dir, "eval_items").select("item_id", F.size(pieces).alias("n_pieces"), F.sha2(F.array_join(pieces, "|"), 256).alias("sha256"))


def vector_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    coded = records.vector_codec(rows, "vec_id", "embedding").join(rows, "vec_id")
    return coded.select("vec_id", F.length("encoded").alias("n_letters"), (F.col("decoded") == F.col("embedding")).alias("same"), F.round(records.similarity_of(F.lit(0.25)), 6).alias("similarity"))


def projected_parents(spark, sf_dir):
    rows = table(spark, sf_dir, "legal_child_v2").select("document_identity", F.array_join("section_path", "/").alias("path"), "child_id", "content", F.col("content").contains("|").alias("atomic"))
    return records.parent_projection(rows, ["document_identity", "path"], "child_id").select("document_identity", "path", "n_children", F.sha2("content", 256).alias("sha256"))


def gold_set_gate(spark, sf_dir):
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "query", "target_doc", F.col("passage").alias("phrase"))
    parents = _parents(spark, sf_dir).groupBy(F.col("external_parent_id").alias("doc_id")).agg(F.max("content").alias("text"), F.max("document_identity").alias("document_identity"))
    hits = retrieval.bm25(items, parents.select("doc_id", "text"), k=5).join(parents, "doc_id")
    return records.gold_gate(hits, items)


QUERIES = {f.__name__: f for f in (
    identities_of_documents, frequent_laws, parent_metadata_keys, inherited_quality_flags, mapped_parents, headed_children, resolved_users, orphan_chunk_counts, listed_block_coverage, decision_totals, final_counts,
    question_distributions, source_dictionary, lines_without_junk, interleaved_blocks, answer_slices, vector_round_trip, projected_parents, gold_set_gate,
)}


def _gold_sql() -> str:
    from lexweave.plans.retrieval import _bm25

    return f"""WITH par AS (SELECT external_parent_id, max(content) AS content, max(document_identity) AS document_identity FROM legal_parent_contract_v1 GROUP BY 1), {_bm25('par', 'external_parent_id', 'content', 5)},
f AS (SELECT item_id, coalesce(bool_or(starts_with(document_identity, target_doc || '@')), false) AS d, coalesce(bool_or(contains(regexp_replace(content, '\\s+', '', 'g'), regexp_replace(passage, '\\s+', '', 'g'))), false) AS p
  FROM eval_items LEFT JOIN bm ON bm.query_id = item_id LEFT JOIN par ON external_parent_id = doc_id GROUP BY 1),
c AS (SELECT count(*) AS n, count(*) FILTER (d) AS n_document, count(*) FILTER (p) AS n_phrase, count(*) FILTER (d OR p) AS n_passed FROM f)
SELECT *, CASE WHEN n_passed >= 0.8::DOUBLE * n THEN 'PASS' ELSE 'FAIL' END AS gate FROM c"""


SQL = {
    "identities_of_documents": "SELECT document_identity, count(*) AS n FROM legal_parent_contract_v1 WHERE string_split(document_identity, '@sha256:')[1] IN (SELECT target_doc FROM eval_items) GROUP BY 1",
    "frequent_laws": "SELECT law, count(*) AS n FROM citation_verdicts WHERE law IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "parent_metadata_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(metadata)) AS key FROM legal_parent_contract_v1) WHERE key NOT IN ('page', 'lang') GROUP BY 1",
    "inherited_quality_flags": "SELECT doc_id, concat_ws(',', CASE WHEN lang IS NOT NULL THEN 'qg_lang' END, CASE WHEN status IS NOT NULL THEN 'qgate_status' END) AS flags FROM documents",
    "mapped_parents": "SELECT DISTINCT child_id, external_parent_id, length(content)::INTEGER AS n_chars FROM legal_child_parent_map_v1 JOIN (SELECT external_parent_id, arg_max(content, (created_at, content)) AS content FROM legal_parent_contract_v1 GROUP BY 1) USING (external_parent_id)",
    "headed_children": """WITH m AS (SELECT DISTINCT document_identity, 'title: ' || string_split(document_identity, '@')[1] AS h FROM legal_parent_contract_v1 WHERE created_at < TIMESTAMP '2024-07-01')
SELECT child_id, sha256(coalesce(h || chr(10) || chr(10) || content, content)) AS sha256 FROM (SELECT DISTINCT child_id, document_identity, content FROM legal_child_v2) LEFT JOIN m USING (document_identity)""",
    "resolved_users": "SELECT visitor_id, coalesce(c_custkey + 1000000, visitor_id) AS user_id, c_custkey IS NULL AS anonymous FROM (SELECT DISTINCT user_id AS visitor_id FROM events) LEFT JOIN customer ON c_custkey = visitor_id AND c_mktsegment = 'BUILDING'",
    "orphan_chunk_counts": """SELECT source_site, count(*) AS chunks, count(*) FILTER (coalesce(block_type = 'HEADING', false)) AS heading_only,
count(*) FILTER (NOT coalesce(block_type = 'HEADING', false) AND length(text_preview) <= 30 AND len(regexp_extract_all(text_preview, '第[一二三四五六七八九十百]+条')) = 1) AS article_orphans FROM block_decisions WHERE text_preview IS NOT NULL GROUP BY 1""",
    "listed_block_coverage": """WITH l AS (SELECT DISTINCT document_identity, unnest(block_orders) AS o FROM duplicate_groups), e AS (SELECT DISTINCT document_identity, original_block_order AS o FROM block_decisions)
SELECT document_identity, count(*) AS n_blocks, round(100.0::DOUBLE * count(l.o) / count(*), 4) AS coverage_pct FROM e LEFT JOIN l USING (document_identity, o) GROUP BY 1""",
    "decision_totals": """WITH v AS (SELECT DISTINCT verdict_id, status FROM citation_verdicts), x AS (SELECT status, verdict_id FROM v WHERE status IN ('article_missing', 'law_not_in_evidence') QUALIFY row_number() OVER (PARTITION BY status ORDER BY verdict_id) <= 8)
SELECT status, n, examples FROM (SELECT status, count(*) AS n FROM v GROUP BY 1) LEFT JOIN (SELECT status, string_agg(verdict_id::VARCHAR, ',' ORDER BY verdict_id) AS examples FROM x GROUP BY 1) USING (status)""",
    "final_counts": """SELECT name, actual, expected, actual = expected AS ok FROM (SELECT 'rows' AS name, (SELECT count(*) FROM legal_parent_contract_v1) AS actual, 612::BIGINT AS expected
UNION ALL SELECT 'identities', (SELECT count(DISTINCT document_identity) FROM legal_parent_contract_v1), 60 UNION ALL SELECT 'map_rows', (SELECT count(*) FROM legal_child_parent_map_v1), 0)""",
    "question_distributions": "SELECT dimension, value, count(*) AS n FROM (SELECT 'query_type' AS dimension, query_type AS value FROM eval_items UNION ALL SELECT 'difficulty', difficulty FROM eval_items UNION ALL SELECT 'lang', lang FROM eval_items) GROUP BY ALL",
    "source_dictionary": """WITH k AS (SELECT source, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 8)
SELECT source, n, examples FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) JOIN (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM k GROUP BY 1) USING (source)""",
    "lines_without_junk": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS k, ls FROM d),
t AS (SELECT doc_id, k, length(trim(ls[k + 1], ' ')) < 12 AS junk, regexp_matches(ls[k + 1], '[0-9]') AS digit FROM l), w AS (SELECT *, coalesce(lag(junk) OVER (PARTITION BY doc_id ORDER BY k), false) AS after FROM t)
SELECT doc_id, count(*) AS n_lines, sum(k)::BIGINT AS line_sum FROM w WHERE NOT junk AND NOT (digit AND after) GROUP BY 1""",
    "interleaved_blocks": "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity), floor(l_discount * 100), l_returnflag, l_linenumber))::INTEGER AS place FROM lineitem",
    "answer_slices": """SELECT item_id, ceil(length(passage) / 40)::INTEGER AS n_pieces, sha256(array_to_string(list_transform(generate_series(0, ((length(passage) - 1) // 40)::BIGINT), lambda k: substr(passage, k * 40 + 1, 40)), '|')) AS sha256 FROM eval_items""",
    "vector_round_trip": "SELECT vec_id, (((len(embedding) * 4 + 2) // 3) * 4)::INTEGER AS n_letters, true AS same, 0.75::DOUBLE AS similarity FROM embeddings",
    "projected_parents": """SELECT document_identity, path, count(*) AS n_children, sha256(string_agg(content, chr(10) || chr(10) ORDER BY child_id, content)) AS sha256
FROM (SELECT DISTINCT document_identity, array_to_string(section_path, '/') AS path, child_id, content FROM legal_child_v2 WHERE content IS NOT NULL AND NOT contains(content, '|')) GROUP BY ALL HAVING count(*) >= 2""",
    "gold_set_gate": _gold_sql(),
}

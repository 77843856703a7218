"""Catalogue entries of joins, upserts, reconciliation, metadata, contracts, citations and star-schema checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.text import normalize_date, parent_id, sentences, words_only
from lexweave.operators import chunking, citations, contract, ingest, metadata
from lexweave.session import table


def whitelist_semi(spark, sf_dir):
    allowed = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(allowed, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"))


def orphan_anti(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(used, "c_custkey", "left_anti").select("c_custkey")


def identity_reconcile(spark, sf_dir):
    return ingest.reconcile(table(spark, sf_dir, "legal_parent_contract_v1"), table(spark, sf_dir, "legal_child_v2"), "document_identity")


def child_set_reconcile(spark, sf_dir):
    return ingest.reconcile(table(spark, sf_dir, "legal_child_parent_map_v1"), table(spark, sf_dir, "legal_child_v2"), "child_id")


def multiset_diff(spark, sf_dir):
    a = table(spark, sf_dir, "legal_child_parent_map_v1").select("child_id", "external_parent_id")
    return ingest.multiset_difference(a, table(spark, sf_dir, "legal_child_v2").select("child_id", "external_parent_id"))


def upsert_replace(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = orders.filter("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("R"))
    return ingest.replace_rows(orders, new, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def delete_documents(spark, sf_dir):
    kept = ingest.delete_rows(table(spark, sf_dir, "legal_parent_contract_v1"), table(spark, sf_dir, "parent_deletions"), "external_parent_id")
    return kept.groupBy("document_identity").agg(F.count_distinct("external_parent_id").alias("n_parents"))


def identity_fingerprint(spark, sf_dir):
    return ingest.fingerprint(table(spark, sf_dir, "legal_parent_contract_v1"), "document_identity")


def package_violations(spark, sf_dir):
    return ingest.package_violations(table(spark, sf_dir, "legal_child_v2")).groupBy("violation").agg(F.count("*").alias("n"))


def verify_write(spark, sf_dir):
    return ingest.verify_write(*(table(spark, sf_dir, t) for t in ("legal_parent_contract_v1", "legal_child_parent_map_v1", "legal_child_v2")))


def select_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "legal_parent_contract_v1").select(F.split("document_identity", "@")[0].alias("logical_document_id"), "content", "created_at")
    manifest = rows.filter("created_at < timestamp_ntz '2024-07-01'").groupBy("logical_document_id").agg(F.max(F.sha2("content", 256)).alias("normalized_sha256"))
    incoming = rows.groupBy("logical_document_id").agg(F.max(F.sha2("content", 256)).alias("normalized_sha256")).withColumn("source_file", F.concat("logical_document_id", F.lit(".md")))
    return ingest.select_documents(manifest, incoming).groupBy("action").agg(F.count("*").alias("n"))


def renamed_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "legal_child_v2").select("child_id", "content")
    return ingest.rename_repeated_ids(rows, "child_id", "content").agg(F.count("*").alias("n"), F.count_distinct("child_id").alias("n_ids"))


def parent_sections(spark, sf_dir):
    return ingest.sections(table(spark, sf_dir, "legal_parent_contract_v1").select("document_identity", "external_parent_id", "section_path", "content", "created_at").distinct())


def parent_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "legal_parent_contract_v1").select("external_parent_id", "document_identity", "section_path").distinct()
    return rows.select("external_parent_id", parent_id(F.col("document_identity"), F.lit(0), F.col("section_path")).alias("derived_id"))


def interval_overlap(spark, sf_dir):
    """Windows of a text joined with its lines by overlapping spans; both sides are keyed by document and window slot."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("text").isNotNull())
    step = chunking.WINDOW - chunking.OVERLAP
    parts = F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    lines = docs.select("doc_id", F.posexplode(F.arrays_zip(F.slice(ends, 1, F.size(parts)).alias("a"), parts.alias("n"))).alias("line_no", "s")).select("doc_id", "line_no", F.col("s.a").alias("ls"), (F.col("s.a") + F.col("s.n") - 1).alias("le")).filter("le > ls")
    slots = lines.withColumn("slot", F.explode(F.sequence(F.greatest(F.floor((F.col("ls") - chunking.WINDOW) / step) + 1, F.lit(0)), F.floor((F.col("le") - 1) / step))))
    lengths = docs.select("doc_id", F.length("text").alias("n"))
    overlap = slots.join(lengths, "doc_id").filter((F.col("slot") * step < F.col("n")) & (F.col("slot") * step < F.col("le")) & (F.col("slot") * step + chunking.WINDOW > F.col("ls")))
    return overlap.groupBy("doc_id", F.col("slot").alias("window_no")).agg(F.count("*").alias("n_lines"))


def citation_titles(spark, sf_dir):
    laws = table(spark, sf_dir, "citation_verdicts").select("law").filter("law <> ''").distinct()
    titles = table(spark, sf_dir, "law_titles").select("law_id", "title")  # 240 rows, fixed
    return laws.join(F.broadcast(titles), citations.law_matches(F.col("law"), F.col("title"))).groupBy("law").agg(F.count("*").alias("n_titles"), F.min("law_id").alias("first_law_id"))


def citation_extract(spark, sf_dir):
    return citations.extract_citations(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def citation_verify(spark, sf_dir):
    parents = table(spark, sf_dir, "legal_parent_contract_v1").select("external_parent_id", "content").distinct()
    rows = parents.select(F.xxhash64("external_parent_id").alias("answer_id"), F.col("content").alias("answer"), F.array("content").alias("evidence"))
    return citations.verify_citations(rows).groupBy("status").agg(F.count("*").alias("n"))


_RENT_ACT = "[Source Metadata]\ntitle=中华人民共和国租赁法\nsource_file=a.pdf\n\n第三十条 出租人应当在三十日内退还押金，并\n—9—\n出具收据；逾期的，按百分之五支付违约金。\n第三十一条 承租人应当按月支付租金。"
_CITATION_CASES = (
    (1, "依据《租赁法》：第三十条: 出租人应当在三十日内退还押金，并出具收据", [_RENT_ACT]),  # words of the article
    (2, "依据《租赁法》第三十条: 按百分之五十支付违约金。", [_RENT_ACT]),  # another number
    (3, "依据《租赁法》第三十一条: 承租人应当按月交付租金。", [_RENT_ACT]),  # one letter of eleven differs
    (4, "依据《租赁法》第三十一条: 施工图纸由登记机关保存。", [_RENT_ACT]),  # other words
    (5, "依据《租赁法》第四十条: 承租人可以解除合同。", [_RENT_ACT]),
    (6, "《海商法》第三十条: 出租人应当退还押金。", [_RENT_ACT]),
    (7, "根据《租赁法》第三十条的规定办理", [_RENT_ACT]),  # spoken of, not quoted
    (8, "《租赁法》第三十条、第三十一条、第三十九条至第四十条", [_RENT_ACT]),
    (9, "第三十条有规定", [_RENT_ACT]),
    (10, "《租赁法》第三十条", []),
    (11, "《租赁法》第三十条：逾期的，按百分之五支付违约金。出租人应当在三十日内退还押金。", [_RENT_ACT]),  # sentences in another order
    (12, None, [_RENT_ACT]),
)


def citation_cases(spark, sf_dir):
    """The ladder of checks over answers and evidence of known outcome."""
    rows = spark.createDataFrame(list(_CITATION_CASES), "answer_id long, answer string, evidence array<string>")
    return citations.verify_citations(rows).select("answer_id", "place", "law", "article", "status")


def cn_numeral_table(spark, sf_dir):
    return citations.numerals(spark)


def normalized_quotes(spark, sf_dir):
    rows = table(spark, sf_dir, "citation_verdicts").select("verdict_id", "evidence_snippet").distinct()
    return rows.select("verdict_id", words_only("evidence_snippet").alias("plain"), F.size(sentences("evidence_snippet")).alias("n_sentences"))


def published_dates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize_date("published_on").alias("published"))


def metadata_resolve(spark, sf_dir):
    fields = ["title", "category", "status", "source", "published_on", "lang"]
    names = {"category": "document_type", "source": "source_org", "published_on": "publish_date", "lang": "region"}
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.struct(F.lit(names.get(f, f)).alias("raw_key"), F.col(f).alias("raw_value")) for f in fields])).alias("c")).select("doc_id", "c.*")
    keyed = rows.filter(F.col("raw_value").isNotNull()).withColumn("field", metadata.canonical_field(F.col("raw_key"))).withColumn("tier", F.lit(metadata.PARSER))
    return metadata.resolve(keyed).select("doc_id", "field", "status", "value", "confidence")


def field_matrix(spark, sf_dir):
    return metadata.field_matrix(metadata_resolve(spark, sf_dir).withColumn("n_candidates", F.lit(1)), table(spark, sf_dir, "documents").count())


def contract_violations(spark, sf_dir):
    chunks = chunking.with_chunk_ids(chunking.child_windows(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("string")
    rows = chunks.select(
        "chunk_id", F.col("doc_id").cast("string").alias("document_id"), F.lit("documents.parquet").alias("source_file"), F.sha2("content", 256).alias("source_sha256"), F.lit("txt").alias("source_format"), F.col("chunk_index"),
        F.array(F.col("start").cast("int"), F.col("end").cast("int")).alias("block_orders"), F.col("start").cast("int").alias("order_start"), F.col("end").cast("int").alias("order_end"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
        F.lit(None).cast("array<int>").alias("pages"), none.alias("chapter"), none.alias("section"), F.when(F.col("chunk_index") % 5 == 0, " ").alias("article"), F.lit(False).alias("contains_table"), F.lit(None).cast("array<int>").alias("table_orders"),
        none.alias("parent_chunk_id"), none.alias("chunk_level"), F.lit(None).cast("map<string,string>").alias("extras"), F.when(F.col("chunk_index") % 3 == 0, "N/A").alias("title"),
    )
    return contract.violations(rows).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def projection_policy(spark, sf_dir):
    return contract.projection_table(spark).groupBy("filter_class", "embedding").agg(F.count("*").alias("n"), F.count_if("required").alias("n_required"))


def star_revenue(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def block_action_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "block_decisions").dropDuplicates(["document_identity", "original_block_order", "action", "rule_id"])
    return rows.groupBy("action").agg(F.count("*").alias("n_blocks"), F.count_distinct("rule_id").alias("n_rules"))


def html_candidate_score(spark, sf_dir):
    from lexweave.sources.html import candidate_score

    rows = table(spark, sf_dir, "page_candidates").dropDuplicates(["page_id", "candidate_no"])
    return rows.select("page_id", "candidate_no", F.round(candidate_score(), 4).alias("score"))


QUERIES = {f.__name__: f for f in (
    whitelist_semi, orphan_anti, identity_reconcile, child_set_reconcile, multiset_diff, upsert_replace, delete_documents, identity_fingerprint, package_violations, verify_write, select_documents, renamed_ids, parent_sections, parent_ids, interval_overlap,
    citation_titles, citation_extract, citation_verify, citation_cases, cn_numeral_table, normalized_quotes, published_dates, metadata_resolve, field_matrix, contract_violations, projection_policy, star_revenue, block_action_summary, html_candidate_score,
)}

_DATE = r"""
CASE WHEN regexp_matches(p, '^\d{4}年\d{1,2}月\d{1,2}日') THEN regexp_extract(p, '^(\d{4})年(\d{1,2})月(\d{1,2})日', ['y', 'm', 'd'])
     WHEN regexp_matches(p, '^\d{4}-\d{1,2}-\d{1,2}') THEN regexp_extract(p, '^(\d{4})-(\d{1,2})-(\d{1,2})', ['y', 'm', 'd'])
     WHEN regexp_matches(p, '^\d{4}/\d{1,2}/\d{1,2}') THEN regexp_extract(p, '^(\d{4})/(\d{1,2})/(\d{1,2})', ['y', 'm', 'd'])
     WHEN regexp_matches(p, '^\d{4}\.\d{1,2}\.\d{1,2}') THEN regexp_extract(p, '^(\d{4})\.(\d{1,2})\.(\d{1,2})', ['y', 'm', 'd']) END"""
_PUBLISHED = f"""WITH p AS (SELECT doc_id, trim(published_on) AS p FROM documents), x AS (SELECT doc_id, {_DATE} AS x FROM p),
dates AS (SELECT doc_id, CASE WHEN x.m::INT BETWEEN 1 AND 12 AND x.d::INT BETWEEN 1 AND CASE WHEN x.m::INT = 2 THEN 29 WHEN x.m::INT IN (4, 6, 9, 11) THEN 30 ELSE 31 END
  THEN x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') END AS published FROM x)
"""
_RESOLVED = _PUBLISHED + """,
raw AS (SELECT doc_id, 'title' AS field, nullif(trim(title), '') AS value FROM documents WHERE title IS NOT NULL UNION ALL SELECT doc_id, 'document_type', nullif(trim(category), '') FROM documents WHERE category IS NOT NULL
  UNION ALL SELECT doc_id, 'legal_status', nullif(trim(status), '') FROM documents WHERE status IS NOT NULL UNION ALL SELECT doc_id, 'source_org', nullif(trim(source), '') FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT doc_id, 'region', nullif(trim(lang), '') FROM documents WHERE lang IS NOT NULL UNION ALL SELECT d.doc_id, 'publish_date', published FROM dates JOIN documents d USING (doc_id) WHERE published_on IS NOT NULL),
res AS (SELECT doc_id, field, CASE WHEN value IS NULL THEN 'NORMALIZATION_FAILED' ELSE 'RESOLVED' END AS status, value, CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM raw)
"""
_SCORE = """coalesce(length, 0) + 500 * coalesce(n_headings, 0) + 30 * coalesce(n_paragraphs, 0) - 5000 * coalesce(link_density, 0) - 80 * coalesce(short_links, 0) + 2000 * coalesce(chapter_hits, 0) + 3000 * coalesce(article_hits, 0) + 4500 * coalesce(end_hit::INT, 0) + 5500 * coalesce(start_hit::INT, 0)
 + 2000 * coalesce(has_first_article_front::INT, 0) + 2000 * coalesce(has_first_chapter_front::INT, 0) - 1500 * coalesce(tail_penalty::INT, 0)"""

SQL = {
    "whitelist_semi": "SELECT o_orderstatus, count(*) AS n_orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "orphan_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "identity_reconcile": "WITH a AS (SELECT DISTINCT document_identity FROM legal_parent_contract_v1), b AS (SELECT DISTINCT document_identity FROM legal_child_v2) SELECT document_identity, 'left_only' AS side FROM a WHERE document_identity NOT IN (SELECT * FROM b WHERE document_identity IS NOT NULL) UNION ALL SELECT document_identity, 'right_only' FROM b WHERE document_identity NOT IN (SELECT * FROM a WHERE document_identity IS NOT NULL)",
    "child_set_reconcile": "WITH a AS (SELECT DISTINCT child_id FROM legal_child_parent_map_v1), b AS (SELECT DISTINCT child_id FROM legal_child_v2) SELECT child_id, 'left_only' AS side FROM a WHERE child_id NOT IN (SELECT * FROM b) UNION ALL SELECT child_id, 'right_only' FROM b WHERE child_id NOT IN (SELECT * FROM a)",
    "multiset_diff": "SELECT child_id, external_parent_id, sum(n)::BIGINT AS surplus FROM (SELECT child_id, external_parent_id, 1 AS n FROM legal_child_parent_map_v1 UNION ALL SELECT child_id, external_parent_id, -1 FROM legal_child_v2) GROUP BY ALL HAVING sum(n) <> 0",
    "upsert_replace": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "delete_documents": "SELECT document_identity, count(DISTINCT external_parent_id) AS n_parents FROM legal_parent_contract_v1 WHERE external_parent_id NOT IN (SELECT external_parent_id FROM parent_deletions) GROUP BY 1",
    "identity_fingerprint": """WITH h AS (SELECT sha256(v) AS h FROM (SELECT DISTINCT document_identity AS v FROM legal_parent_contract_v1 WHERE document_identity IS NOT NULL)),
p AS (SELECT k, coalesce(sum(('0x' || substr(h, 12 * k + 1, 12))::UBIGINT), 0)::VARCHAR AS s FROM (SELECT unnest(generate_series(0, 4)) AS k) LEFT JOIN h ON true GROUP BY k)
SELECT (SELECT count(*) FROM h) AS n, sha256((SELECT count(*) FROM h)::VARCHAR || '|' || (SELECT string_agg(s, '|' ORDER BY k) FROM p)) AS fingerprint""",
    "package_violations": r"""SELECT v AS violation, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT coalesce(regexp_matches(child_id, '^[0-9a-f]{32}$'), false) THEN 'child_id' END, CASE WHEN NOT coalesce(regexp_matches(external_parent_id, '^[0-9a-f]{64}$'), false) THEN 'external_parent_id' END,
CASE WHEN coalesce(trim(content), '') = '' THEN 'content_blank' END, CASE WHEN length(content) > 8000 THEN 'content_too_long' END, CASE WHEN coalesce(len(section_path), 0) = 0 THEN 'section_path_empty' END, CASE WHEN source_file IS NULL THEN 'source_file_missing' END]) AS v FROM legal_child_v2) WHERE v IS NOT NULL GROUP BY 1""",
    "verify_write": """SELECT *, expected = actual AS ok FROM (SELECT 'orphan_parents' AS "check", 0::BIGINT AS expected, count(*) AS actual FROM (SELECT DISTINCT external_parent_id FROM legal_child_v2 WHERE external_parent_id IS NULL OR external_parent_id NOT IN (SELECT external_parent_id FROM legal_parent_contract_v1))
UNION ALL SELECT 'unmapped_children', 0, count(*) FROM (SELECT DISTINCT child_id FROM legal_child_v2 WHERE child_id NOT IN (SELECT child_id FROM legal_child_parent_map_v1)) UNION ALL SELECT 'repeated_children', 0, count(*) FROM (SELECT child_id FROM legal_child_v2 GROUP BY 1 HAVING count(*) > 1))""",
    "select_documents": """WITH r AS (SELECT string_split(document_identity, '@')[1] AS id, sha256(content) AS s, created_at FROM legal_parent_contract_v1), m AS (SELECT id, max(s) AS k FROM r WHERE created_at < TIMESTAMP '2024-07-01' GROUP BY 1), i AS (SELECT id, max(s) AS s FROM r GROUP BY 1)
SELECT CASE WHEN k IS NULL THEN 'new' WHEN k = s THEN 'unchanged' ELSE 'needs_replace_flag' END AS action, count(*) AS n FROM i LEFT JOIN m USING (id) GROUP BY 1""",
    "renamed_ids": "SELECT count(*) AS n, count(*) AS n_ids FROM legal_child_v2 WHERE trim(content) <> ''",
    "parent_sections": """WITH r AS (SELECT DISTINCT document_identity, external_parent_id, section_path, content, created_at FROM legal_parent_contract_v1), f AS (SELECT *, coalesce(section_path[1], '') AS head FROM r),
g AS (SELECT *, coalesce((lag(head) OVER w <> head)::INT, 1) AS fresh FROM f WINDOW w AS (PARTITION BY document_identity ORDER BY created_at, external_parent_id)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY document_identity ORDER BY created_at, external_parent_id) AS run FROM g)
SELECT document_identity, run::BIGINT AS run, min(head) AS head, count(*) AS n_rows, sum(length(content))::BIGINT AS n_chars FROM n GROUP BY document_identity, run""",
    "parent_ids": "SELECT DISTINCT external_parent_id, sha256(document_identity || '|0|' || array_to_string(section_path, '|')) AS derived_id FROM legal_parent_contract_v1",
    "interval_overlap": """WITH d AS (SELECT doc_id, text, length(text) AS n, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, n, unnest(generate_series(1, len(ls))) AS k, ls FROM d),
s AS (SELECT doc_id, n, length(ls[k]) AS m, (SUM(length(ls[k]) + 1) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT - length(ls[k]) - 1 AS a FROM l),
w AS (SELECT doc_id, unnest(generate_series(0, (n - 1) // 384)) AS window_no FROM d WHERE n > 0)
SELECT doc_id, window_no, count(*) AS n_lines FROM s JOIN w USING (doc_id) WHERE m > 0 AND window_no * 384 < a + m AND window_no * 384 + 512 > a GROUP BY ALL""",
    "citation_titles": """WITH l AS (SELECT DISTINCT law FROM citation_verdicts WHERE law <> ''), t AS (SELECT law_id, title FROM law_titles)
SELECT law, count(*) AS n_titles, min(law_id) AS first_law_id FROM (SELECT law, law_id, regexp_replace(law, '^中华人民共和国', '') AS c, regexp_replace(title, '^中华人民共和国', '') AS k, title FROM l, t) WHERE law = title OR (c <> '' AND k <> '' AND (c = k OR (length(c) > 2 AND contains(k, c)))) GROUP BY 1""",
    "citation_cases": """SELECT answer_id::BIGINT AS answer_id, place::INTEGER AS place, law, article::INTEGER AS article, status FROM (VALUES
 (1, 0, '租赁法', 30, 'grounded'), (2, 0, '租赁法', 30, 'text_mismatch'), (3, 0, '租赁法', 31, 'grounded'), (4, 0, '租赁法', 31, 'text_mismatch'), (5, 0, '租赁法', 40, 'article_missing'), (6, 0, '海商法', 30, 'law_not_in_evidence'), (7, 0, '租赁法', 30, 'grounded'),
 (8, 0, '租赁法', 30, 'grounded'), (8, 1, '租赁法', 31, 'grounded'), (8, 2, '租赁法', 39, 'article_missing'), (8, 3, '租赁法', 40, 'article_missing'), (9, 0, '', 30, 'grounded'), (11, 0, '租赁法', 30, 'grounded')) AS t(answer_id, place, law, article, status)""",
    "cn_numeral_table": """WITH n AS (SELECT unnest(generate_series(1, 9999)) AS n), p AS (SELECT n, n // 1000 AS k, n // 100 % 10 AS h, n // 10 % 10 AS t, n % 10 AS u, '零一二三四五六七八九' AS z FROM n)
SELECT n::INTEGER AS n, CASE WHEN k > 0 THEN substr(z, k + 1, 1) || '千' ELSE '' END || CASE WHEN h > 0 THEN substr(z, h + 1, 1) || '百' WHEN k > 0 AND (t > 0 OR u > 0) THEN '零' ELSE '' END
 || CASE WHEN t = 1 AND n < 100 THEN '十' WHEN t > 0 THEN substr(z, t + 1, 1) || '十' WHEN h > 0 AND u > 0 THEN '零' ELSE '' END || CASE WHEN u > 0 THEN substr(z, u + 1, 1) ELSE '' END AS numeral FROM p""",
    "normalized_quotes": r"""WITH r AS (SELECT DISTINCT verdict_id, evidence_snippet AS e FROM citation_verdicts)
SELECT verdict_id, regexp_replace(regexp_replace(coalesce(e, ''), '—\s*[0-9]+\s*—', '', 'g'), '[^\p{L}\p{M}\p{N}_]', '', 'g') AS plain,
 len(list_filter(string_split_regex(e, '[。；;：:!！？?]'), lambda x: regexp_replace(regexp_replace(x, '—\s*[0-9]+\s*—', '', 'g'), '[^\p{L}\p{M}\p{N}_]', '', 'g') <> ''))::INTEGER AS n_sentences FROM r""",
    "published_dates": _PUBLISHED + "SELECT * FROM dates",
    "metadata_resolve": _RESOLVED + "SELECT * FROM res",
    "field_matrix": _RESOLVED + """, m AS (SELECT field, count(*) AS present, count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (status = 'CONFLICT') AS conflicts, count(DISTINCT value) AS distinct_values, round(avg(confidence), 4) AS avg_confidence FROM res GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT m.*, round(present::DOUBLE / n, 6) AS presence, CASE WHEN resolved::DOUBLE / n >= 0.8 AND distinct_values <= 50 THEN 'FILTER_COLUMN' WHEN resolved::DOUBLE / n >= 0.3 THEN 'JSON_FIELD' ELSE 'IGNORE' END AS advice FROM m, n""",
    "star_revenue": "SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "block_action_summary": "SELECT action, count(*) AS n_blocks, count(DISTINCT rule_id) AS n_rules FROM (SELECT DISTINCT document_identity, original_block_order, action, rule_id FROM block_decisions) GROUP BY 1",
    "html_candidate_score": f"SELECT page_id, candidate_no, round(CASE WHEN coalesce(length, 0) < 100 THEN -1 ELSE {_SCORE} END, 4)::DOUBLE AS score FROM (SELECT * FROM page_candidates QUALIFY row_number() OVER (PARTITION BY page_id, candidate_no) = 1)",
}

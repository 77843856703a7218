"""Catalogue entries of blocks, structure, cleaning decisions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexweave.operators import blocks, chunking
from lexweave.plans.documents import norm_sql, strip_sql
from lexweave.session import shared_folder, spread, table


def _blocks(spark, sf_dir):
    return blocks.markdown_blocks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def markdown_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "order", "type", F.length("text").alias("n_chars"))


def block_types(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_blocks"), F.count_distinct("doc_id").alias("n_documents"))


def dominant_block_type(spark, sf_dir):
    return blocks.dominant_type(_blocks(spark, sf_dir), ["doc_id"])


def forward_fill_structure(spark, sf_dir):
    return blocks.sticky_structure(_blocks(spark, sf_dir)).select("doc_id", "order", "chapter", "section", "article")


def structure_chunks(spark, sf_dir):
    return blocks.structure_chunks(_blocks(spark, sf_dir)).select("doc_id", "run", "part", "chapter", "section", "article", F.length("content").alias("n_chars"))


def block_cleaner(spark, sf_dir):
    rows = table(spark, sf_dir, "block_decisions").groupBy("document_identity", "original_block_order").agg(F.max(F.struct("decided_at", "block_type", "text_preview")).alias("r"))
    ordered = rows.select(F.col("document_identity").alias("doc_id"), F.col("original_block_order").alias("order"), F.col("r.block_type").alias("type"), F.when(F.col("r.block_type") == "HEADING", 1).alias("level"), F.col("r.text_preview").alias("text"), F.lit("html").alias("format"))
    return blocks.clean_blocks(ordered).groupBy("action", "rule_id").agg(F.count("*").alias("n"))


def table_parts(spark, sf_dir):
    lines = table(spark, sf_dir, "page_candidates").filter("tag = 'table'").dropDuplicates(["page_id", "candidate_no"])
    rows = F.transform(F.split("text", "\n"), lambda x: F.array(x))
    return chunking.split_tables(lines.select("page_id", "candidate_no", F.array(F.lit("line")).alias("headers"), rows.alias("rows"))).select("page_id", "candidate_no", "part", F.size("rows").alias("n_rows"))


def _stream(spark, sf_dir, build, mode, name):
    from lexweave.streaming import events

    source = f"{sf_dir}/events.parquet"
    out = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))

    def land(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    build(events, rows).writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/data")


def stream_tumbling(spark, sf_dir):
    counts = _stream(spark, sf_dir, lambda e, rows: e.tumbling_counts(rows), "update", "tumbling")
    last = counts.groupBy(F.col("window.start").alias("start"), "event_type").agg(F.max_by(F.struct("n", "total"), "batch_id").alias("r"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "r.n", F.round("r.total", 4).alias("total"))


def stream_rate_limit(spark, sf_dir):
    return _stream(spark, sf_dir, lambda e, rows: e.rate_limit_stream(rows, 5, 86400), "append", "limit").select("user_id", "event_id", F.col("n_in_window").cast("long").alias("n_in_window"), "allowed")


def stream_memory(spark, sf_dir):
    rows = _stream(spark, sf_dir, lambda e, rows: e.memory_stream(rows, 3), "update", "memory")
    return rows.groupBy("user_id").agg(F.array_join(F.max_by("lines", "batch_id"), ",").alias("last_types"))


QUERIES = {f.__name__: f for f in (markdown_blocks, block_types, dominant_block_type, forward_fill_structure, structure_chunks, block_cleaner, table_parts, stream_tumbling, stream_rate_limit, stream_memory)}

_MARKDOWN = rf"""WITH l AS (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1)) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, n, ls[n + 1] AS line, length(regexp_extract(ls[n + 1], '^(#{{1,9}})\s+\S', 1)) AS level, {strip_sql('ls[n + 1]')} = '' AS blank FROM l),
f AS (SELECT *, (level > 0 OR blank OR coalesce(lag(level) OVER w > 0 OR lag(blank) OVER w, true))::INT AS fresh FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM f),
p AS (SELECT doc_id, g, max(level) AS level, string_agg(line, chr(10) ORDER BY n) AS raw FROM s WHERE NOT blank GROUP BY doc_id, g),
md AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS "order", CASE WHEN level > 0 THEN 'HEADING' WHEN regexp_matches(raw, '^\s*([-*+•]|\d+[.)、]|[（(][一二三四五六七八九十\d]+[)）])\s*\S') THEN 'LIST_ITEM' ELSE 'PARAGRAPH' END AS type,
  CASE WHEN level > 0 THEN level::INTEGER END AS level, {norm_sql("CASE WHEN level > 0 THEN regexp_replace(raw, '^#{1,9}" + chr(92) + "s+', '') ELSE raw END")} AS text FROM p)
"""

SQL = {
    "markdown_blocks": _MARKDOWN + 'SELECT doc_id, "order", type, length(text)::INTEGER AS n_chars FROM md',
    "dominant_block_type": _MARKDOWN + """, c AS (SELECT doc_id, type, count(*) AS n, min("order") AS first FROM md WHERE type NOT IN ('METADATA', 'UNKNOWN') GROUP BY ALL)
SELECT doc_id, type AS dominant_type FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1""",
    "forward_fill_structure": _MARKDOWN + r""", m AS (SELECT doc_id, "order", nullif(regexp_extract(text, '^\s*(第[一二三四五六七八九十百千零〇\d]+章)', 1), '') AS c, nullif(regexp_extract(text, '^\s*(第[一二三四五六七八九十百千零〇\d]+节)', 1), '') AS s,
  nullif(regexp_extract(text, '^\s*(第[一二三四五六七八九十百千零〇\d]+条)', 1), '') AS a FROM md),
w AS (SELECT doc_id, "order", last_value(c IGNORE NULLS) OVER v AS chapter, last_value(s IGNORE NULLS) OVER v AS s, last_value(a IGNORE NULLS) OVER v AS a, coalesce(max(CASE WHEN c IS NOT NULL THEN "order" END) OVER v, -1) AS pc,
  coalesce(max(CASE WHEN s IS NOT NULL THEN "order" END) OVER v, -1) AS ps, coalesce(max(CASE WHEN a IS NOT NULL THEN "order" END) OVER v, -1) AS pa FROM m WINDOW v AS (PARTITION BY doc_id ORDER BY "order" ROWS UNBOUNDED PRECEDING))
SELECT doc_id, "order", chapter, CASE WHEN ps >= pc THEN s END AS section, CASE WHEN pa >= greatest(pc, ps) THEN a END AS article FROM w""",
    "block_types": _MARKDOWN + "SELECT type, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_documents FROM md GROUP BY 1",
    "table_parts": """WITH t AS (SELECT DISTINCT page_id, candidate_no, string_split(text, chr(10)) AS ls FROM page_candidates WHERE tag = 'table'),
g AS (SELECT *, len(ls) AS n, CASE WHEN len(ls) <= 20 OR list_sum(list_transform(ls, lambda x: length(x))) <= 800 THEN len(ls) ELSE 10 END AS size FROM t),
p AS (SELECT page_id, candidate_no, n, size, unnest(generate_series(0, (n - 1) // size)) AS part FROM g)
SELECT page_id, candidate_no, part::INTEGER AS part, least(size, n - part * size)::INTEGER AS n_rows FROM p""",
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_memory": "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS last_types FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3) GROUP BY 1",
    "stream_rate_limit": """WITH w AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n_in_window FROM events)
SELECT user_id, event_id, n_in_window, n_in_window <= 5 AS allowed FROM w""",
}

"""Catalogue entries of memory, limits, caches and time windows over the event and verdict tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.functions.text import cache_key, micros
from lexweave.operators import retrieval, state
from lexweave.session import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def rate_limit_sliding(spark, sf_dir):
    return state.rate_limit(_events(spark, sf_dir), "user_id", "ts", "event_id", limit=5, seconds=86400).select("user_id", "event_id", "n_in_window", "allowed")


def rate_limit_retry_after(spark, sf_dir):
    refused = state.rate_limit(_events(spark, sf_dir), "user_id", "ts", "event_id", limit=5, seconds=86400).filter(~F.col("allowed"))
    return refused.select("user_id", "event_id", "retry_after")


def memory_last_n(spark, sf_dir):
    return state.last_turns(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], 3).select("user_id", "line_no", "event_id", "event_type")


def memory_prune(spark, sf_dir):
    return state.prune(_events(spark, sf_dir).select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], 50).select("user_id", "event_id")


def prompt_format(spark, sf_dir):
    turns = state.last_turns(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], 3)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "event_type"))), lambda x: F.concat(F.lit("["), x["line_no"].cast("string"), F.lit("] "), x["event_type"]))
    return turns.groupBy("user_id").agg(F.array_join(lines, "\n").alias("prompt"))


def cache_eviction(spark, sf_dir):
    return state.evict(_events(spark, sf_dir).select("event_type", "ts", "event_id"), ["event_type"], "ts", "event_id", 200).select("event_type", "event_id")


def exact_cache_ttl(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("read_id"), micros("ts").alias("t_us"), "event_type")
    return state.expiring_cache(rows.filter("event_type = 'view'").select("key", "t_us"), rows.filter("event_type <> 'view'").select("key", "read_id", "t_us"), 86400).select("key", "read_id", "hit")


def semantic_cache_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    hits = retrieval.dense_topk(rows.filter("vec_id % 50 = 0"), rows, k=1, others=True)
    return state.semantic_lookup(hits, 0.5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "cache_hit")


def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", cache_key(F.col("query")).alias("cache_key"))


def as_of_preceding(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return state.preceding(rows, ["user_id"], ["ts", "event_id"], "mark").filter("event_type = 'error'").select("user_id", "event_id", "preceding")


def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    rows = _events(spark, sf_dir).select("user_id", "event_id", micros("ts").alias("t_us"))
    fresh = rows.withColumn("fresh", F.coalesce((F.col("t_us") - F.lag("t_us").over(w) > 6 * 3600 * 1000000).cast("int"), F.lit(1))).withColumn("session_no", F.sum("fresh").over(w))
    return fresh.groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


def hot_update_ticks(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.floor(micros("ts") / 60_000_000).alias("tick")).agg(F.count("*").alias("n_changes"))


def verdict_summary(spark, sf_dir):
    from lexweave.operators.citations import summary

    rows = table(spark, sf_dir, "citation_verdicts").dropDuplicates(["verdict_id", "query_id", "status"])
    return summary(rows, ["query_id"])


QUERIES = {f.__name__: f for f in (rate_limit_sliding, rate_limit_retry_after, memory_last_n, memory_prune, prompt_format, cache_eviction, exact_cache_ttl, semantic_cache_lookup, cache_keys, as_of_preceding, sessions, hot_update_ticks, verdict_summary)}

_LIMIT = """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
w AS (SELECT *, count(*) OVER x AS n_in_window, min(t) OVER x AS oldest FROM e WINDOW x AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
"""
_TURNS = "WITH b AS (SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3), l AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS line_no, event_id, event_type FROM b) "

SQL = {
    "rate_limit_sliding": _LIMIT + "SELECT user_id, event_id, n_in_window, n_in_window <= 5 AS allowed FROM w",
    "rate_limit_retry_after": _LIMIT + "SELECT user_id, event_id, greatest(1, floor(86400 - (t - oldest) / 1000000.0::DOUBLE)::BIGINT) AS retry_after FROM w WHERE n_in_window > 5",
    "memory_last_n": _TURNS + "SELECT user_id, line_no, event_id, event_type FROM l",
    "memory_prune": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 50",
    "prompt_format": _TURNS + "SELECT user_id, string_agg('[' || line_no || '] ' || event_type, chr(10) ORDER BY line_no) AS prompt FROM l GROUP BY 1",
    "cache_eviction": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) > 200",
    "exact_cache_ttl": """WITH r AS (SELECT user_id AS key, event_id AS read_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'view'), w AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events WHERE event_type = 'view')
SELECT r.key, read_id, coalesce(r.t - max(w.t) < 86400000000, false) AS hit FROM r LEFT JOIN w ON w.key = r.key AND w.t <= r.t GROUP BY r.key, read_id, r.t""",
    "semantic_cache_lookup": """SELECT query_id, vec_id, round(s, 6) AS similarity, s >= 0.5 AS cache_hit FROM (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s
FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) = 1""",
    "cache_keys": "SELECT item_id, substr(sha1(trim(query)), 1, 16) AS cache_key FROM eval_items",
    "as_of_preceding": """SELECT user_id, event_id, preceding FROM (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceding FROM events) WHERE event_type = 'error'""",
    "sessions": """WITH f AS (SELECT user_id, event_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000)::INT, 1) AS fresh FROM events),
s AS (SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM f) SELECT user_id, session_no::BIGINT AS session_no, count(*) AS n_events, min(event_id) AS first_event FROM s GROUP BY ALL""",
    "hot_update_ticks": "SELECT epoch_us(ts) // 60000000 AS tick, count(*) AS n_changes FROM events GROUP BY 1",
    "verdict_summary": """SELECT query_id, count(*) AS total, count(*) FILTER (status = 'grounded') AS grounded, count(*) FILTER (status = 'text_mismatch') AS text_mismatch, count(*) FILTER (status = 'article_missing') AS article_missing,
count(*) FILTER (status = 'law_not_in_evidence') AS law_not_in_evidence FROM (SELECT DISTINCT verdict_id, query_id, status FROM citation_verdicts) GROUP BY 1""",
}

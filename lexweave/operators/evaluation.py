"""Retrieval evaluation: hit rate, recall, reciprocal rank, intervals, failure samples and release gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CITE_TOLERANCE, FALLBACK_SHARE = 0.03, 0.15


def per_query(results: DataFrame) -> DataFrame:
    """Hit, citation hit and reciprocal rank of each query and strategy; ``results`` has one row a rank."""
    return results.groupBy("strategy", "query_type", "difficulty", "query_id").agg(F.max(F.col("hit").cast("int")).alias("hit"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"), F.max(F.col("cite_hit").cast("int")).alias("cite_hit")).withColumn("rr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def metrics(results: DataFrame) -> DataFrame:
    """Hit rate, recall, mean reciprocal rank and citation hit rate per strategy, overall and per query type."""
    agg = [F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("cite_hit"), 6).alias("cite_hit_rate")]
    return per_query(results).groupingSets([["strategy"], ["strategy", "query_type"]], "strategy", "query_type").agg(*agg).withColumn("query_type", F.coalesce("query_type", F.lit("ALL")))


def paired(results: DataFrame, a: str, b: str) -> DataFrame:
    """One row a query with the outcomes of two strategies side by side."""
    q = per_query(results).filter(F.col("strategy").isin(a, b))
    side = lambda s, p: F.max(F.when(F.col("strategy") == s, F.col(p)))
    return q.groupBy("query_id", "query_type", "difficulty").agg(*[side(s, p).alias(f"{p}_{n}") for n, s in (("a", a), ("b", b)) for p in ("hit", "rr", "cite_hit", "first_rank")])


def bootstrap_interval(pairs: DataFrame, draws: DataFrame) -> DataFrame:
    """Mean difference B - A with its 95% interval over a table of draws (resample, slot, query_no).

    The draws are a table, so that an interval can be made again; queries are numbered by id.
    """
    numbered = pairs.withColumn("query_no", F.row_number().over(Window.orderBy("query_id")) - 1)  # one row a query of the evaluation set
    means = draws.join(numbered, "query_no").groupBy("resample").agg(F.avg(F.col("rr_b") - F.col("rr_a")).alias("d_mrr"), F.avg(F.col("hit_b") - F.col("hit_a")).alias("d_recall"))
    bounds = [F.round(F.percentile(c, q), 6).alias(f"{c}_{n}") for c in ("d_mrr", "d_recall") for n, q in (("low", 0.025), ("high", 0.975))]
    return means.agg(F.count("*").alias("resamples"), *bounds)


def draws_table(spark, n_queries: int, resamples: int = 1000, seed: int = 20260821) -> DataFrame:
    """Query numbers drawn with replacement by a hash of seed, resample and slot."""
    grid = spark.range(resamples * n_queries).select((F.col("id") / n_queries).cast("long").alias("resample"), (F.col("id") % n_queries).alias("slot"))
    return grid.withColumn("query_no", F.pmod(F.xxhash64(F.lit(seed), "resample", "slot"), F.lit(n_queries)).cast("int"))


def failure_samples(pairs: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` queries of each kind of difference, hard ones first."""
    kind = (
        F.when((F.col("hit_a") == 1) & (F.col("hit_b") == 0), "a_hit_b_miss")
        .when((F.col("hit_a") == 0) & (F.col("hit_b") == 1), "a_miss_b_hit")
        .when((F.col("hit_a") == 0) & (F.col("hit_b") == 0), "both_miss")
        .when(F.abs(F.col("first_rank_a") - F.col("first_rank_b")) >= 3, "rank_gap")
    )
    hard = F.when(F.col("difficulty") == "hard", 0).when(F.col("difficulty") == "medium", 1).otherwise(2)
    rows = pairs.withColumn("bucket", kind).filter(F.col("bucket").isNotNull())
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(hard, "query_id"))).filter(F.col("place") <= most).select("bucket", "place", "query_id", "difficulty")


def release_gate(overall: DataFrame, a: str, b: str, fallback_share: float = 0.0) -> DataFrame:
    """PASS if B recalls as well as A, cites no worse than ``CITE_TOLERANCE`` below it, and falls back seldom (M8)."""
    rows = overall.filter(F.col("query_type") == "ALL")
    value = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    sides = rows.agg(value(a, "recall").alias("recall_a"), value(b, "recall").alias("recall_b"), value(a, "cite_hit_rate").alias("cite_a"), value(b, "cite_hit_rate").alias("cite_b"))
    ok = (F.col("recall_b") >= F.col("recall_a")) & (F.col("cite_b") >= F.col("cite_a") - CITE_TOLERANCE) & F.lit(fallback_share <= FALLBACK_SHARE)
    return sides.withColumn("gate", F.when(ok, "PASS").otherwise("FAIL"))


def latency_summary(times: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, nearest-rank percentiles and maximum of latencies."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return times.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(value).alias("max"))


def embedding_quality(vectors: DataFrame, dimension: int) -> DataFrame:
    """Counts of rows, repeated ids, wrong dimensions and vectors that are not of unit length (M9)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return vectors.agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("vec_id")).alias("n_repeated"), F.count_if(F.size("embedding") != dimension).alias("n_wrong_dimension"), F.count_if(F.abs(norm - 1) >= 1e-4).alias("n_not_unit"))

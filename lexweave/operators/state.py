"""State over event tables: chat memory, rate limits, exact and semantic caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import micros

MEMORY_LINES, MEMORY_KEPT = 10, 50
LIMIT, WINDOW_SECONDS = 12, 60
CACHE_TTL_SECONDS, CACHE_MAX, CACHE_THRESHOLD = 3600, 200, 0.97


def last_turns(history: DataFrame, key: str, order: list[str], lines: int = MEMORY_LINES) -> DataFrame:
    """The last ``lines`` rows of each key in ascending order."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    kept = history.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= lines)
    return kept.withColumn("line_no", F.row_number().over(Window.partitionBy(key).orderBy(*order))).drop("back")


def prune(history: DataFrame, key: str, order: list[str], keep: int = MEMORY_KEPT) -> DataFrame:
    """The rows beyond the ``keep`` newest of each key, which are to be deleted."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return history.withColumn("back", F.row_number().over(newest)).filter(F.col("back") > keep).drop("back")


def rate_limit(events: DataFrame, key: str, time: str, id_column: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Whether each request is within the sliding window's limit; refused requests count too.

    Requests of the same instant are told apart by their id. ``retry_after`` is the wait until the oldest request
    leaves the window, at least 1 second.
    """
    rows = events.select(key, id_column, micros(time).alias("t_us"))
    w = Window.partitionBy(key).orderBy("t_us").rangeBetween(-seconds * 1_000_000, 0)
    seen = rows.withColumn("n_in_window", F.count("*").over(w)).withColumn("oldest_us", F.min("t_us").over(w))
    refused = F.col("n_in_window") > limit
    wait = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(seconds) - (F.col("t_us") - F.col("oldest_us")) / 1_000_000))
    return seen.withColumn("allowed", ~refused).withColumn("retry_after", F.when(refused, wait)).drop("oldest_us")


def semantic_lookup(hits: DataFrame, threshold: float = CACHE_THRESHOLD) -> DataFrame:
    """The best cached entry of each query if it is similar enough (Z3); ``hits`` are ranked dense hits."""
    return hits.filter(F.col("rank") == 1).withColumn("cache_hit", F.col("similarity") >= threshold)


def evict(entries: DataFrame, by: list[str], time: str, id_column: str, most: int = CACHE_MAX) -> DataFrame:
    """The oldest entries beyond ``most`` of each cache version."""
    w = Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col(id_column).desc())
    return entries.withColumn("age_rank", F.row_number().over(w)).filter(F.col("age_rank") > most).drop("age_rank")


def expiring_cache(writes: DataFrame, reads: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """For each read (key, read_id, t_us) whether the key's last earlier write (key, t_us) is still alive.

    Reads and writes are merged into one timeline per key, so it takes one shuffle and no range join.
    """
    both = reads.select("key", "read_id", "t_us", F.lit(None).cast("long").alias("written_us")).unionByName(writes.select("key", F.lit(None).cast("long").alias("read_id"), "t_us", F.col("t_us").alias("written_us")))
    w = Window.partitionBy("key").orderBy("t_us", F.col("read_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    last = both.withColumn("last_us", F.last("written_us", ignorenulls=True).over(w)).filter(F.col("read_id").isNotNull())
    return last.select("key", "read_id", "t_us", F.coalesce(F.col("t_us") - F.col("last_us") < ttl_seconds * 1_000_000, F.lit(False)).alias("hit"))


def preceding(rows: DataFrame, by: list[str], order: list[str], marks: str) -> DataFrame:
    """As-of: each row with the last marked value strictly before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("preceding", F.last(marks, ignorenulls=True).over(w))

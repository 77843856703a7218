"""Cutting texts into child windows, size statistics, duplicate ratios, and table parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import chunk_id, normalize_ws, strip

WINDOW, OVERLAP = 512, 128
OVERSIZED, VERY_SMALL = 1200, 64
SHINGLE = 8
TABLE_ROWS, TABLE_CHARS, TABLE_GROUP = 20, 800, 10


def _starts(length: Column, window: int, step: int, stop_at_end: bool) -> Column:
    last = F.when(length <= window, F.lit(0)).otherwise(F.ceil((length - window) / F.lit(step)) * step if stop_at_end else F.floor((length - 1) / F.lit(step)) * step)
    return F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))


def child_windows(documents: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, overlap: int = OVERLAP, stop_at_end: bool = False) -> DataFrame:
    """Overlapping character windows of each normalised text.

    A text within one window is one chunk; blank windows are left out. The plain form also gives a last window that
    the one before wholly contains; ``stop_at_end`` (N3) stops with the first window that reaches the end.
    """
    rows = documents.select(F.col(id_column), normalize_ws(text).alias("t")).filter(F.length("t") > 0)
    cut = rows.withColumn("n", F.length("t")).select(id_column, "t", "n", F.posexplode(_starts(F.col("n"), window, window - overlap, stop_at_end)).alias("chunk_index", "start"))
    pieces = cut.select(id_column, F.col("chunk_index").cast("long"), "start", F.least(F.col("start") + window, F.col("n").cast("long")).alias("end"), F.expr(f"substring(t, cast(start as int) + 1, {window})").alias("content"), "n")
    kept = pieces.filter(F.length(strip("content")) > 0)
    return kept.withColumn("is_tail", (F.col("end") == F.col("n")) & (F.col("start") > 0)).drop("n")


def with_chunk_ids(chunks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Adds the deterministic id, from the content's hash, the document, the index and the offsets."""
    return chunks.withColumn("chunk_id", chunk_id(F.sha2("content", 256), F.col(id_column).cast("string"), F.col("chunk_index"), F.col("start"), F.col("end")))


def length_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunk length statistics with interpolated percentiles and size flags (G2, G3 and the size counts of G5)."""
    n = F.length("content")
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"),
        F.round(F.avg(n), 4).alias("avg_chars"),
        F.round(F.percentile(n, 0.5), 4).alias("median_chars"),
        F.round(F.percentile(n, 0.95), 4).alias("p95_chars"),
        F.min(n).alias("min_chars"),
        F.max(n).alias("max_chars"),
        F.count_if(n > OVERSIZED).alias("oversized"),
        F.count_if(n < VERY_SMALL).alias("very_small"),
    )


def weighted_rollup(stats: DataFrame, by: list[str]) -> DataFrame:
    """Roll-up of ``length_stats`` weighted by chunk count; medians and percentiles become weighted means."""
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("chunks")) / F.sum("chunks"), 4).alias(c)
    return stats.groupBy(*by).agg(F.sum("chunks").alias("total_chunks"), mean("avg_chars"), mean("median_chars"), mean("p95_chars"), F.min("min_chars").alias("min_chars"), F.max("max_chars").alias("max_chars"))


def coverage(chunks: DataFrame, lengths: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Share of a text's characters that its windows cover (G7); windows are ordered, so gaps follow from lag."""
    w = Window.partitionBy(id_column).orderBy("start")
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), F.lit(0))
    covered = chunks.select(id_column, "start", "end").withColumn("fresh", fresh).groupBy(id_column).agg(F.sum("fresh").alias("covered"))
    return lengths.join(covered, id_column, "left").select(id_column, F.round(100.0 * F.coalesce("covered", F.lit(0)) / F.col("n"), 4).alias("coverage_pct"))


def _repeated_share(size: int):
    def share(text: str) -> float:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        hashes = np.zeros(max(0, len(codes) - size + 1), dtype=np.uint64)
        for k in range(size if len(hashes) else 0):
            hashes = (hashes + codes[k : k + len(hashes)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(32)
        counts = np.unique(hashes, return_counts=True)[1]
        return min(1.0, int(counts[counts > 1].sum()) / len(codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([share(t) for t in batch.column(1).to_pylist()], pa.float64())], [batch.schema.names[0], "duplicate_ratio"])

    return run


def duplicate_ratio(documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Share of a text's characters at which a repeated ``size``-character run starts, at most 1.

    The runs of a text are hashed and counted where the text is, so nothing is shuffled. Blank and null texts give no
    row, a text shorter than a run has none repeated, and a repeated row gives its share again.
    """
    rows = documents.select(id_column, normalize_ws(text).alias("t")).filter(F.length("t") > 0)
    return rows.mapInArrow(_repeated_share(size), f"{id_column} {dict(documents.dtypes)[id_column]}, duplicate_ratio double").withColumn("duplicate_ratio", F.round("duplicate_ratio", 6))


def split_tables(tables: DataFrame, header: str = "headers", rows: str = "rows") -> DataFrame:
    """Parts of tables: small ones whole, others in groups of rows under the repeated header; no row is ever lost."""
    n, chars = F.size(rows), F.aggregate(rows, F.lit(0), lambda a, r: a + F.length(F.array_join(r, " | ")))
    small = (n <= TABLE_ROWS) | (chars <= TABLE_CHARS)
    group = F.when(small, F.greatest(n, F.lit(1))).otherwise(TABLE_GROUP)
    parts = tables.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / group) - 1, F.lit(0)).cast("int")))).withColumn("size", group)
    return parts.withColumn(rows, F.slice(rows, F.col("part") * F.col("size") + 1, F.col("size"))).drop("size")

"""Chunk metadata contract: seventeen numbered invariants as one array of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import chunk_id

# fixed values: markers that must never leave the chunker, and strings that stand for null
SENTINELS = ["__METADATA_BLOCK_VALUE__", "__UNSET__", "__NONE__", "__CHUNKER_INTERNAL__"]
PSEUDO_NULLS = ["N/A", "NA", "UNKNOWN", "UNSET", "TBD", "NONE"]
#: Fields inherited from the document: name, required, filter class, cited, embedding policy.
PROJECTION = [
    ("document_id", True, "scalar", True, "citation"), ("logical_document_id", False, "scalar", True, "citation"), ("title", True, "json", True, "prefix"), ("source_org", False, "scalar", True, "prefix"),
    ("publish_date", False, "scalar", True, "filter"), ("creation_date", False, "scalar", True, "filter"), ("effective_date", False, "scalar", True, "filter"), ("expiry_date", False, "scalar", True, "filter"),
    ("document_number", False, "scalar", True, "citation"), ("document_index_number", False, "json", False, "citation"), ("document_type", False, "scalar", True, "filter"), ("authority_level", False, "json", True, "prefix"),
    ("legal_status", False, "json", True, "filter"), ("jurisdiction", False, "scalar", True, "filter"), ("region", False, "scalar", False, "filter"), ("theme_category", False, "scalar", False, "filter"),
    ("source_url", False, "json", False, "citation"), ("source_file", True, "scalar", False, "filter"),
]
INHERITED = ["title", "source_org", "publish_date", "creation_date", "effective_date", "expiry_date", "document_number", "document_index_number", "document_type", "authority_level", "legal_status", "jurisdiction", "region", "theme_category", "source_url"]


def projection_table(spark) -> DataFrame:
    """The inheritance table as rows, for joins that drive projections."""
    return spark.createDataFrame(PROJECTION, "field string, required boolean, filter_class string, cited boolean, embedding string")


def inherit(chunks: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks with the document's fields; null stays null and an empty string becomes null."""
    fields = [name for name, *_ in PROJECTION if name != key and name in documents.columns and name not in chunks.columns]
    return chunks.join(documents.select(key, *[F.nullif(F.col(f), F.lit("")).alias(f) for f in fields]), key, "left")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def violations(chunks: DataFrame) -> DataFrame:
    """``chunks`` with an array of the invariants each row breaks, empty where it keeps all.

    Columns: chunk_id, document_id, source_file, source_sha256, source_format, chunk_index, block_orders,
    order_start, order_end, page_start, page_end, pages, chapter, section, article, contains_table, table_orders,
    parent_chunk_id, chunk_level, extras (map), and any of ``INHERITED``.
    """
    orders, pages = F.col("block_orders"), F.coalesce("pages", F.array().cast("array<int>"))
    text = [c for c, t in chunks.dtypes if t == "string"]
    sentinel = F.lit(False)
    for c in text:
        for s in SENTINELS:
            sentinel = sentinel | F.coalesce(F.col(c).contains(s), F.lit(False))
    pseudo = F.lit(False)
    for c in INHERITED:
        if c in chunks.columns:
            pseudo = pseudo | F.coalesce(F.upper(F.trim(c)).isin(PSEUDO_NULLS), F.lit(False))
    emptied = F.lit(False)
    for c in ("chapter", "section", "article"):
        emptied = emptied | (F.col(c).isNotNull() & _blank(c))
    n = F.size(orders)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i >= n) | (F.get(orders, i - 1) < F.get(orders, i)))
    expected = chunk_id(F.col("source_sha256"), F.col("document_id"), F.col("chunk_index"), F.col("order_start"), F.col("order_end"))
    again = F.from_json(F.to_json(F.struct("chunk_id", "document_id", "chunk_index", "block_orders")), "chunk_id string, document_id string, chunk_index long, block_orders array<int>")
    checks = [
        ("INV1", ~F.coalesce(F.col("chunk_id").rlike("^[0-9a-f]{32}$"), F.lit(False))),
        ("INV2", _blank("document_id")),
        ("INV3", _blank("source_file") | _blank("source_format") | ~F.coalesce(F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)) | (F.coalesce("chunk_index", F.lit(-1)) < 0)),
        ("INV4", (F.coalesce(n, F.lit(0)) <= 0) | F.coalesce(orders == F.array(F.lit(-1)), F.lit(False))),
        ("INV5", (n > 1) & ~rising),
        ("INV6", (n > 0) & (F.size(F.array_distinct(orders)) != n)),
        ("INV7", (n > 0) & ((F.col("order_start") != F.array_min(orders)) | (F.col("order_end") != F.array_max(orders)))),
        ("INV8", F.col("page_start") > F.col("page_end")),
        ("INV9", F.exists(pages, lambda p: (p < F.col("page_start")) | (p > F.col("page_end")))),
        ("INV10", emptied),
        ("INV11", sentinel),
        ("INV12", F.coalesce(F.size("extras"), F.lit(0)) > 0),
        ("INV13", F.col("contains_table") & (F.size(F.array_except(F.coalesce("table_orders", F.array().cast("array<int>")), orders)) > 0)),
        ("INV14", F.col("parent_chunk_id").isNotNull() & ~F.coalesce(F.col("chunk_level").isin("child", "parent"), F.lit(False))),
        ("INV15", pseudo),
        ("INV16", (F.to_json(again) != F.to_json(F.struct("chunk_id", "document_id", "chunk_index", "block_orders")))),
    ]
    base = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]), lambda v: v.isNotNull())
    marked = chunks.withColumn("violations", base)
    stale = (F.size("violations") == 0) & (F.col("order_start") >= 0) & (F.col("order_end") >= F.col("order_start")) & (expected != F.col("chunk_id"))
    return marked.withColumn("violations", F.when(F.coalesce(stale, F.lit(False)), F.array(F.lit("INV17"))).otherwise(F.col("violations")))

"""Lines repeated across one source's documents: hash, count distinct documents, threshold, rebuild."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize

MIN_DOCUMENTS = 3
MIN_SHARE = 0.2
SALTS = 16  # parts in which the blocks of one frequent line are joined


def _width_map() -> tuple[str, str]:
    """Characters with one compatibility form of one letter, digit or sign, as a from and a to string."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for first, last in ((0xFF01, 0xFFDC), (0x2160, 0x217F), (0x2460, 0x2468), (0x2F00, 0x2FD5), (0xF900, 0xFAD9)) for c in range(first, last + 1)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


WIDE, PLAIN = _width_map()
_WIDE_LETTER = r"[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uffdc\u2160-\u217f\u2460-\u2468\u2f00-\u2fd5\uf900-\ufad9]"  # signs fall away


def line_key(text: Column) -> Column:
    """A line without letter case, width, spacing, punctuation and the values of its numbers; null if nothing is left."""
    x = F.lower(F.when(text.rlike(_WIDE_LETTER), F.translate(text, WIDE, PLAIN)).otherwise(text))
    x = F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}]+", "")
    x = F.regexp_replace(x, r"\p{Nd}+", "0")
    return F.when(F.length(x) > 0, x)


def block_lines(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """The distinct (site, document, order, line hash) of blocks that have a line.

    A block without a preview takes the text of the group that lists its order.
    """
    own = blocks.select("source_site", "document_identity", "original_block_order", "text_preview").filter(F.col("document_identity").isNotNull())
    listed = groups.select("document_identity", F.explode("block_orders").alias("original_block_order"), F.col("normalized_text").alias("group_text")).filter(F.col("group_text").isNotNull()).groupBy("document_identity", "original_block_order").agg(F.min("group_text").alias("group_text"))
    missing = own.filter(F.col("text_preview").isNull()).drop("text_preview").distinct().join(listed, ["document_identity", "original_block_order"])
    lines = own.filter(F.col("text_preview").isNotNull()).withColumnRenamed("text_preview", "line").unionByName(missing.withColumnRenamed("group_text", "line"))
    keyed = lines.select("source_site", "document_identity", "original_block_order", line_key(F.col("line")).alias("key")).filter(F.col("key").isNotNull())
    return keyed.select("source_site", "document_identity", "original_block_order", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")).distinct()


def frequent_lines(lines: DataFrame, blocks: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """Site and hash of each line that stands in enough documents, with their number and share."""
    sizes = blocks.select("source_site", "document_identity").filter(F.col("document_identity").isNotNull()).distinct().groupBy("source_site").agg(F.count("*").alias("n_site_documents"))
    counts = lines.select("source_site", "h1", "h2", "document_identity").distinct().groupBy("source_site", "h1", "h2").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= min_documents)
    joined = counts.alias("a").join(sizes.alias("b"), F.col("a.source_site").eqNullSafe(F.col("b.source_site"))).select("a.*", "n_site_documents")
    return joined.withColumn("share", F.col("n_documents") / F.col("n_site_documents")).filter(F.col("n_documents") >= F.lit(min_share) * F.col("n_site_documents") - 1e-9)


def repeated_blocks(blocks: DataFrame, groups: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, salts: int = SALTS) -> DataFrame:
    """The blocks to remove: those whose line is frequent within their site.

    Lines are equal but for case, width, spacing, punctuation and numbers. Null previews without a listing group, and
    lines of signs alone, are never frequent; blocks without a document are left out; a null site is a site of its own;
    repeated and late rows of a block count once; a block with several previews is removed if one of them is frequent.
    The documents of a line are counted after a distinct over the document too, so no task holds a hot line's rows, and
    the frequent lines are joined back in ``salts`` parts.
    """
    lines = materialize(block_lines(blocks, groups))
    often = frequent_lines(lines, blocks, min_documents, min_share).select(F.col("source_site").alias("s"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("g_salt"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("document_identity"), F.lit(salts)).cast("int"))
    hit = salted.join(often, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("salt") == F.col("g_salt")) & F.col("source_site").eqNullSafe(F.col("s")), "left_semi")
    return hit.select("document_identity", "original_block_order").distinct()


def cleaned_documents(blocks: DataFrame, groups: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """Each document's lines in order without the frequent ones, and how many blocks were kept and removed.

    The latest row of a block gives its text, ties by the greater text; a block without any text counts but adds none.
    """
    gone = repeated_blocks(blocks, groups, min_documents, min_share).withColumn("removed", F.lit(True))
    listed = groups.select("document_identity", F.explode("block_orders").alias("original_block_order"), F.col("normalized_text").alias("group_text")).groupBy("document_identity", "original_block_order").agg(F.min("group_text").alias("group_text"))
    latest = blocks.filter(F.col("document_identity").isNotNull()).groupBy("document_identity", "original_block_order").agg(F.max(F.struct("decided_at", F.col("text_preview"))).getField("text_preview").alias("text_preview"))
    rows = latest.join(listed, ["document_identity", "original_block_order"], "left").join(gone, ["document_identity", "original_block_order"], "left")
    kept = F.col("removed").isNull()
    ordered = F.array_sort(F.collect_list(F.when(kept, F.struct("original_block_order", F.coalesce("text_preview", "group_text").alias("line")))))
    return rows.groupBy("document_identity").agg(
        F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_removed"), F.array_join(F.transform(ordered, lambda b: b["line"]), "\n").alias("text")
    )

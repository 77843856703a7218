"""Upserts, reconciliation, selection and verification of document packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CONTENT = 8000


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the new keys replaced by ``new`` (M3); running it twice changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_rows(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``gone`` (M1)."""
    return old.join(gone.select(key).distinct(), key, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one store holds."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").filter(F.col("l").isNull() | F.col("r").isNull()).select(key, F.when(F.col("r").isNull(), "left_only").otherwise("right_only").alias("side"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the number of times that one side holds them more often (G22, U4), by one aggregation."""
    columns = left.columns
    both = left.withColumn("n", F.lit(1)).unionByName(right.select(*columns).withColumn("n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("n").alias("surplus")).filter(F.col("surplus") != 0)


def fingerprint(rows: DataFrame, column: str) -> DataFrame:
    """Count of a column's distinct values and one order-free hash of them.

    The five 48-bit pieces of the values' SHA-256 are added up each, so the hash is partial per task and never gathers
    the set; the SHA-256 of the count and the five sums is the fingerprint. Nulls do not count.
    """
    values = rows.select(F.sha2(F.col(column).cast("string"), 256).alias("h")).filter(F.col("h").isNotNull()).distinct()
    pieces = [F.sum(F.conv(F.substring("h", 12 * k + 1, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(5)]
    sums = values.agg(F.count("*").alias("n"), *pieces)
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(f"p{k}", F.lit(0)).cast("string") for k in range(5)]), 256).alias("fingerprint"))


def fetch_parents(ids: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents of distinct ids in first-seen order, and the violations that make the fetch fail.

    ``ids``: external_parent_id, position.
    """
    wanted = ids.groupBy("external_parent_id").agg(F.min("position").alias("position"))
    found = wanted.join(parents.select("external_parent_id", "content").dropDuplicates(["external_parent_id"]), "external_parent_id", "left")
    bad = found.select("external_parent_id", F.when(F.col("content").isNull(), "missing").when(F.length("content") > MAX_CONTENT, "too_long").alias("violation")).filter(F.col("violation").isNotNull())
    return found.filter(F.col("content").isNotNull()), bad


def package_violations(children: DataFrame) -> DataFrame:
    """Breaches of the child contract, one row each (M4)."""
    checks = [
        ("child_id", ~F.coalesce(F.col("child_id").rlike("^[0-9a-f]{32}$"), F.lit(False))),
        ("external_parent_id", ~F.coalesce(F.col("external_parent_id").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("content_blank", F.coalesce(F.trim("content"), F.lit("")) == ""),
        ("content_too_long", F.length("content") > MAX_CONTENT),
        ("section_path_empty", F.coalesce(F.size("section_path"), F.lit(0)) <= 0),
        ("source_file_missing", F.col("source_file").isNull()),
    ]
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())
    return children.select("child_id", F.explode(found).alias("violation"))


def select_documents(manifest: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """What to do with each incoming document: new, unchanged, replace, or why it is refused.

    ``manifest``: logical_document_id, normalized_sha256; ``incoming``: the same and source_file.
    """
    copies = incoming.withColumn("n_copies", F.count("*").over(Window.partitionBy("logical_document_id")))
    known = manifest.groupBy("logical_document_id").agg(F.max("normalized_sha256").alias("known_sha"), F.count("*").alias("n_known"))
    joined = copies.join(known, "logical_document_id", "left")
    action = (
        F.when(F.col("n_copies") > 1, "duplicate_in_batch")
        .when(F.col("n_known") > 1, "conflict_in_manifest")
        .when(F.col("known_sha").isNull(), "new")
        .when(F.col("known_sha") == F.col("normalized_sha256"), "unchanged")
        .otherwise("replace" if replace else "needs_replace_flag")
    )
    return joined.select("logical_document_id", "source_file", action.alias("action"))


def verify_write(parents: DataFrame, mapping: DataFrame, children: DataFrame) -> DataFrame:
    """Checks after a write: (check, expected, actual, ok) (M7)."""
    long = lambda c: c.cast("long")
    orphans = children.select("external_parent_id").distinct().join(parents.select("external_parent_id").distinct(), "external_parent_id", "left_anti").agg(F.lit("orphan_parents").alias("check"), F.lit(0).cast("long").alias("expected"), long(F.count("*")).alias("actual"))
    unmapped = children.select("child_id").distinct().join(mapping.select("child_id").distinct(), "child_id", "left_anti").agg(F.lit("unmapped_children").alias("check"), F.lit(0).cast("long").alias("expected"), long(F.count("*")).alias("actual"))
    repeated = children.groupBy("child_id").count().filter(F.col("count") > 1).agg(F.lit("repeated_children").alias("check"), F.lit(0).cast("long").alias("expected"), long(F.count("*")).alias("actual"))
    return orphans.unionByName(unmapped).unionByName(repeated).withColumn("ok", F.col("expected") == F.col("actual"))


def rename_repeated_ids(chunks: DataFrame, id_column: str, text: str) -> DataFrame:
    """Chunks without empty texts; an id that came before gets a name of its own from its text's hash."""
    n = F.row_number().over(Window.partitionBy(id_column).orderBy(F.sha2(text, 256)))
    rows = chunks.filter(F.coalesce(F.trim(text), F.lit("")) != "").withColumn("n", n)
    return rows.withColumn(id_column, F.when(F.col("n") == 1, F.col(id_column)).otherwise(F.concat(F.lit("dup_"), F.substring(F.sha2(F.concat_ws("|", id_column, F.col("n").cast("string"), text), 256), 1, 16)))).drop("n")


def sections(parents: DataFrame) -> DataFrame:
    """Runs of consecutive rows of a document with the same first path part (W6), in time order."""
    w = Window.partitionBy("document_identity").orderBy("created_at", "external_parent_id")
    head = F.coalesce(F.element_at("section_path", 1), F.lit(""))
    flagged = parents.withColumn("head", head).withColumn("fresh", F.coalesce((F.lag("head").over(w) != F.col("head")).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("run", F.sum("fresh").over(w))
    return numbered.groupBy("document_identity", "run").agg(F.first("head").alias("head"), F.count("*").alias("n_rows"), F.sum(F.length("content")).alias("n_chars"))

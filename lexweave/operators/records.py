"""Small relational operators over records: lookups, projections, totals, dictionaries, codecs and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXAMPLES = 8
SLICE = 40
ORPHAN_CHARS = 30
QUALITY_PREFIXES = ("qgate", "qg_")  # fixed values: keys of inherited quality flags
PARENT_KEYS = ("external_parent_id", "document_identity", "section_path", "content")


def of_documents(rows: DataFrame, names: DataFrame, identity: str = "document_identity", mark: str = "@sha256:") -> DataFrame:
    """Rows whose identity starts with a wanted document name and the hash mark (F3), as an equi semi-join."""
    named = rows.withColumn("_name", F.substring_index(identity, mark, 1)).filter(F.col(identity).contains(mark))
    return named.join(names.toDF("_name").distinct(), "_name", "left_semi").select(*rows.columns)


def frequent_values(rows: DataFrame, column: str, least: int) -> DataFrame:
    """Values of a column on at least ``least`` rows with their number (F4); counted per task before the shuffle."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def without_keys(json: Column | str, keys: tuple[str, ...] = PARENT_KEYS) -> Column:
    """A JSON object as a map without some keys (F8)."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin(*keys))


def quality_flags(json: Column | str) -> Column:
    """The keys of a JSON object that carry quality flags, as a map."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: F.coalesce(*[F.when(k.startswith(p), True) for p in QUALITY_PREFIXES], F.lit(False)))


def mapped_parents(mapping: DataFrame, parents: DataFrame) -> DataFrame:
    """Map rows with their parents (J3); both sides distinct by key first, so no repeated row multiplies."""
    keys = ["child_id", "external_parent_id"]
    one = parents.groupBy("external_parent_id").agg(F.max_by("content", F.struct("created_at", "content")).alias("content"))
    return mapping.select(*keys).distinct().join(one, "external_parent_id")


def with_source_header(hits: DataFrame, manifest: DataFrame, key: str, header: str = "header", text: str = "text") -> DataFrame:
    """Hits under their document's header; a hit without a manifest row keeps its bare text."""
    known = manifest.groupBy(key).agg(F.max(header).alias(header))
    return hits.join(known, key, "left").withColumn(text, F.coalesce(F.concat(F.col(header), F.lit("\n\n"), F.col(text)), F.col(text))).drop(header)


def resolve_users(seen: DataFrame, known: DataFrame) -> DataFrame:
    """User ids of visitors (J19): the account that is bound to one, or else the visitor's own, marked as anonymous."""
    bound = known.groupBy("visitor_id").agg(F.max("user_id").alias("bound_id"))
    return seen.select("visitor_id").distinct().join(bound, "visitor_id", "left").select("visitor_id", F.coalesce("bound_id", "visitor_id").alias("user_id"), F.col("bound_id").isNull().alias("anonymous"))


def orphan_counts(chunks: DataFrame, by: list[str], short: int = ORPHAN_CHARS) -> DataFrame:
    """Chunks that are a heading alone, and those of one article and hardly any text.

    ``chunks``: ``by``, content, kind, n_articles.
    """
    heading = F.coalesce(F.col("kind") == "HEADING", F.lit(False))
    article = ~heading & (F.col("n_articles") == 1) & (F.length("content") <= short)
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_if(heading).alias("heading_only"), F.count_if(article).alias("article_orphans"))


def block_coverage(groups: DataFrame, blocks: DataFrame, by: str = "document_identity") -> DataFrame:
    """Share of a document's blocks that its chunks list (G7). ``groups``: ``by``, block_orders; ``blocks``: ``by``, block_order."""
    listed = groups.select(by, F.explode("block_orders").alias("block_order")).distinct()
    every = blocks.select(by, "block_order").distinct()
    covered = every.join(listed.withColumn("covered", F.lit(1)), [by, "block_order"], "left")
    return covered.groupBy(by).agg(F.count("*").alias("n_blocks"), F.round(100.0 * F.coalesce(F.sum("covered"), F.lit(0)) / F.count("*"), 4).alias("coverage_pct"))


def totals(results: DataFrame, key: str, status: str, failed: list[str]) -> DataFrame:
    """Rows by status, and for statuses of failure the least keys as examples."""
    place = F.row_number().over(Window.partitionBy(status).orderBy(key))
    counts = results.groupBy(status).agg(F.count("*").alias("n"))
    examples = results.filter(F.col(status).isin(failed)).select(status, key).distinct().withColumn("place", place).filter(F.col("place") <= EXAMPLES)
    return counts.join(examples.groupBy(status).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("examples")), status, "left")


def against_expected(actual: DataFrame, expected: dict[str, int]) -> DataFrame:
    """One row a named count with what was expected (G21). ``actual``: one row of counts."""
    cells = [F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("actual"), F.lit(v).cast("long").alias("expected")) for n, v in expected.items()]
    return actual.select(F.explode(F.array(*cells)).alias("c")).select("c.*", (F.col("c.actual") == F.col("c.expected")).alias("ok"))


def distributions(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows by each value of each dimension, from one pass."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def value_dictionary(rows: DataFrame, column: str, example: str, most: int = EXAMPLES) -> DataFrame:
    """Distinct values with their number and the first examples by key (G25); ranks are cut before examples are gathered."""
    first = F.row_number().over(Window.partitionBy(column).orderBy(example))
    kept = rows.filter(F.col(column).isNotNull()).select(column, example).distinct().withColumn("place", first).filter(F.col("place") <= most)
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.join(kept.groupBy(column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(example)), lambda x: x.cast("string")), ",").alias("examples")), column)


def drop_separators_after_junk(lines: DataFrame, by: list[str], order: str, junk: str = "junk", separator: str = "separator") -> DataFrame:
    """Lines without junk rows and without the separator rows that stand right after one."""
    w = Window.partitionBy(*by).orderBy(order)
    return lines.withColumn("_after", F.coalesce(F.lag(junk).over(w), F.lit(False))).filter(~F.col(junk) & ~(F.col(separator) & F.col("_after"))).drop("_after")


def interleave(blocks: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Reading places of text and table blocks of a page, by their top, left and kind."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("y", "x", "kind", tie)))


def text_slices(text: Column | str, size: int = SLICE) -> Column:
    """A text in pieces of a fixed number of characters, as an answer is streamed."""
    t = F.col(text) if isinstance(text, str) else text
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / size) - 1, F.lit(0)).cast("int"))
    return F.when(F.length(t) > 0, F.transform(starts, lambda k: F.substring(t, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def similarity_of(distance: Column | str) -> Column:
    """Cosine similarity of a cosine distance (C17)."""
    return F.lit(1.0) - (F.col(distance) if isinstance(distance, str) else distance)


def vector_codec(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """Vectors as Base64 of little-endian float32, and read back from it (C15); a null vector stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if v is None else np.array(v, dtype="<f4").tobytes() for v in batch.column(1).to_pylist()]
            back = [None if b is None else np.frombuffer(b, dtype="<f4").tolist() for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(back, pa.list_(pa.float32()))], [id_column, "raw", "decoded"])

    coded = vectors.select(id_column, column).mapInArrow(run, f"{id_column} {dict(vectors.dtypes)[id_column]}, raw binary, decoded array<float>")
    return coded.select(id_column, F.translate(F.base64("raw"), "\r\n", "").alias("encoded"), "decoded")


def parent_projection(children: DataFrame, by: list[str], order: str, least: int = 2) -> DataFrame:
    """Parents of the children that share a place in a document (N7): their texts in order, from two children on.

    ``children``: ``by``, ``order``, content and ``atomic``; an atomic child, such as a table, is no part of a parent.
    """
    rows = children.filter(~F.coalesce("atomic", F.lit(False)) & F.col("content").isNotNull()).select(*by, order, "content").distinct()
    ordered = F.array_sort(F.collect_list(F.struct(order, "content")))
    return rows.groupBy(*by).agg(F.count("*").alias("n_children"), F.array_join(F.transform(ordered, lambda c: c["content"]), "\n\n").alias("content")).filter(F.col("n_children") >= least)


def gold_gate(hits: DataFrame, gold: DataFrame, least: float = 0.8, k: int = 5) -> DataFrame:
    """How many gold questions have their document, and their phrase, among the k best hits.

    ``hits``: query_id, rank, document_identity, text; ``gold``: query_id, target_doc, phrase. The document is found by
    the prefix of its identity, the phrase without regard to white space. A question without hits fails.
    """
    plain = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    joined = gold.join(hits.filter(F.col("rank") <= k), "query_id", "left")
    found = joined.groupBy("query_id").agg(
        F.coalesce(F.max(F.col("document_identity").startswith(F.concat("target_doc", F.lit("@")))), F.lit(False)).alias("document"),
        F.coalesce(F.max((plain("phrase") != "") & plain("text").contains(plain("phrase"))), F.lit(False)).alias("phrase"),
    )
    counts = found.agg(F.count("*").alias("n"), F.count_if("document").alias("n_document"), F.count_if("phrase").alias("n_phrase"), F.count_if(F.col("document") | F.col("phrase")).alias("n_passed"))
    return counts.withColumn("gate", F.when(F.col("n_passed") >= F.lit(least) * F.col("n"), "PASS").otherwise("FAIL"))

"""Answer assembly and evaluation helpers: history questions, evidence headers, needles, ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import strip

HEADER_FIELDS = ["title", "source_org", "publish_date", "effective_date", "document_number", "legal_status", "jurisdiction"]
# fixed values: ways to ask about one's own earlier questions
HISTORY = [
    r"我一共问|总共问|一共问|问过几个|问了几个|几个问题", r"前\s*\d+\s*个\s*(问题|问)", r"第\s*\d+\s*个\s*(问题|问)", r"最后\s*\d*\s*个\s*(问题|问)|最后\s*(几|多少)\s*(个\s*)?(问题|问)", r"我最后", r"的\s*\d+\s*个\s*问题", r"历史\s*(问题|记录|聊天)|聊天记录|聊天历史",
    r"我(之前|刚才|前面|上次|早前)(问|提到|说过)", r"我\s*问\s*过\s*(什么|啥)", r"上次\s*问|上回\s*问", r"(回顾|汇总|统计).{0,6}(我|问|聊)", r"(我|咱|俺).{0,4}(哪些|哪几)(个\s*)?(问题|问)",
]


def asks_history(question: Column) -> Column:
    """Whether a question is about the user's own history (F12); one alternation scans it once."""
    s = strip(question)
    return F.coalesce((F.length(s) >= 2) & s.rlike("|".join(f"(?:{p})" for p in HISTORY)), F.lit(False))


def evidence_header(fields: list[str], source_file: Column) -> Column:
    """Header of an evidence text from the fields that are present, in fixed order."""
    lines = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in HEADER_FIELDS if f in fields]
    return F.concat_ws("\n", F.lit("[Source Metadata]"), *lines, F.concat(F.lit("source_file: "), source_file))


def needles(value: Column) -> Column:
    """Spellings under which a value may stand in a text: thousands, percent, Chinese date."""
    v = strip(value)
    whole = v.rlike(r"^-?\d+$")
    share = v.rlike(r"^0\.\d+$")
    date = v.rlike(r"^\d{4}-\d{2}-\d{2}$")
    chinese = F.concat(F.substring(v, 1, 4), F.lit("年"), F.substring(v, 6, 2).try_cast("int").cast("string"), F.lit("月"), F.substring(v, 9, 2).try_cast("int").cast("string"), F.lit("日"))
    grouped = F.format_number(v.try_cast("long"), 0)
    out = F.when(whole, F.array(F.concat(grouped, F.lit("元")), grouped, v)).when(share, F.array(F.concat(F.regexp_replace((v.try_cast("double") * 100).cast("decimal(12,6)").cast("string"), r"\.?0+$", ""), F.lit("%")), v)).when(date, F.array(v, chinese)).otherwise(F.array(v))
    return F.array_distinct(F.filter(out, lambda x: F.coalesce(x, F.lit("")) != ""))


def ground_truth_hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Ranked results with whether their document is right and holds any needle, whatever the case.

    ``results``: query_id, rank, doc_key, text; ``truth``: query_id, doc_keys array, needles array.
    """
    joined = results.join(truth, "query_id")
    right = F.array_contains("doc_keys", F.col("doc_key"))
    holds = F.exists("needles", lambda n: F.lower("text").contains(F.lower(n)))
    return joined.select("query_id", "rank", "doc_key", F.coalesce(right, F.lit(False)).alias("doc_hit"), F.coalesce(right & holds, F.lit(False)).alias("hit"))


def citation_map(truth: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the right document that hold a needle of each field.

    ``truth``: doc_key, field, needles; ``chunks``: chunk_id, doc_key, content. Chunks are matched within their document.
    """
    wanted = truth.select("doc_key", "field", F.explode("needles").alias("needle"))
    hits = wanted.join(chunks, "doc_key").filter(F.col("content").contains(F.col("needle")))
    return hits.groupBy("doc_key", "field").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def review_pairs(a: DataFrame, b: DataFrame, per_document: int = 3) -> DataFrame:
    """The longest chunks of each document by strategy A with the chunks of B that share a block.

    ``a`` and ``b``: doc_id, chunk_id, content, block_orders.
    """
    from pyspark.sql import Window

    top = a.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("content").desc(), "chunk_id"))).filter(F.col("n") <= per_document)
    left = top.select("doc_id", F.col("chunk_id").alias("a_chunk_id"), F.col("block_orders").alias("a_orders"))
    right = b.select("doc_id", F.col("chunk_id").alias("b_chunk_id"), F.col("block_orders").alias("b_orders"))
    return left.join(right, "doc_id").filter(F.arrays_overlap("a_orders", "b_orders")).select("doc_id", "a_chunk_id", "b_chunk_id")


def differs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that two runs do not share, for the determinism gate."""
    from lexweave.operators.ingest import multiset_difference

    return multiset_difference(first, second)

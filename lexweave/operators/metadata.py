"""Document metadata: key aliases, value forms, resolution of candidates, and the field matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import SPACE, normalize_date, normalize_document_number, strip

DATE_FIELDS = ["publish_date", "creation_date", "effective_date", "expiry_date"]
PARSER, BLOCK = 50, 30  # tiers of a candidate's source
# fixed values: names under which documents carry a field
ALIASES = {
    "title": ["title", "标题", "文件标题"],
    "source_org": ["source_org", "发文机关", "发布机关", "制定机关", "印发机关", "主办单位", "来源"],
    "publish_date": ["publish_date", "pubdate", "发布日期", "发布时间"],
    "creation_date": ["creation_date", "created", "成文日期", "成文时间"],
    "effective_date": ["effective_date", "施行日期", "实施日期", "生效日期", "开始施行日期"],
    "expiry_date": ["expiry_date", "expiration_date", "废止日期", "失效日期", "终止日期"],
    "document_number": ["document_number", "发文字号", "文号", "文件编号"],
    "document_type": ["document_type", "doc_type", "文件类型", "公文种类"],
    "authority_level": ["authority_level", "效力级别"],
    "legal_status": ["legal_status", "status", "法律状态", "现行状态"],
    "jurisdiction": ["jurisdiction", "适用区域"],
    "region": ["region", "地域", "所在地区"],
    "source_url": ["source_url"],
    "source_file": ["source_file", "source_path"],
    "document_id": ["document_id", "doc_id"],
    "document_index_number": ["索引号"],
    "theme_category": ["主题分类", "主题"],
}


def canonical_field(key: Column) -> Column:
    """The field that a raw key names, without its colon and inner spaces; null if unknown."""
    plain = F.regexp_replace(F.regexp_replace(strip(key), r"[:：]+$", ""), rf"[{SPACE}]+", "")
    pairs = [x for field, names in ALIASES.items() for name in names for x in (F.lit(name), F.lit(field))]
    return F.try_element_at(F.create_map(*pairs), plain)


def split_pair(line: Column) -> Column:
    """Key and value at the first colon, tab or double space."""
    form = r"^([^：:\t]{1,20}?)(?:[：:\t]|  )(.{1,200})$"
    return F.when(line.rlike(form), F.struct(strip(F.regexp_extract(line, form, 1)).alias("key"), strip(F.regexp_extract(line, form, 2)).alias("value")))


def normalize_value(field: Column, value: Column) -> Column:
    """The value in its field's form; null where it has none."""
    v = strip(value)
    return F.when(field.isin(DATE_FIELDS), normalize_date(v)).when(field == "document_number", normalize_document_number(v)).otherwise(F.when(v != "", v))


def candidates_from_lines(lines: DataFrame, id_column: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """Candidates of lines that hold a known key and a value, or a key whose value is the next line that is not blank."""
    rows = lines.filter(strip(text) != "").select(id_column, order, strip(text).alias("t"))
    w = Window.partitionBy(id_column).orderBy(order)
    paired = rows.withColumn("pair", split_pair(F.col("t"))).withColumn("following", F.lead("t").over(w))
    inline = paired.filter(F.col("pair").isNotNull()).select(id_column, order, F.col("pair.key").alias("raw_key"), F.col("pair.value").alias("raw_value"), F.lit("inline").alias("method"))
    alone = paired.filter(F.col("pair").isNull() & (F.length("t") <= 20) & F.col("following").isNotNull()).select(id_column, order, F.col("t").alias("raw_key"), F.col("following").alias("raw_value"), F.lit("adjacent").alias("method"))
    return inline.unionByName(alone).withColumn("field", canonical_field(F.col("raw_key"))).filter(F.col("field").isNotNull()).withColumn("tier", F.lit(BLOCK))


def resolve(candidates: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row a document and field: status, value and confidence.

    ``candidates``: id, field, raw_value, tier. One value resolves; of several the highest tier's if it is alone there,
    else the field is in conflict; a field without a usable value failed.
    """
    values = candidates.withColumn("value", normalize_value(F.col("field"), F.col("raw_value")))
    buckets = values.groupBy(id_column, "field", "value").agg(F.max("tier").alias("tier"), F.count("*").alias("n"))
    usable = F.when(F.col("value").isNotNull(), F.col("tier"))
    best = buckets.withColumn("best", F.max(usable).over(Window.partitionBy(id_column, "field")))
    at_best = F.col("value").isNotNull() & (F.col("tier") == F.col("best"))
    found = best.groupBy(id_column, "field").agg(F.count("value").alias("n_values"), F.count_if(at_best).alias("n_best"), F.min(F.when(at_best, F.col("value"))).alias("v"), F.first("best").alias("best"), F.sum("n").alias("n_candidates"))
    status = F.when(F.col("n_values") == 0, "NORMALIZATION_FAILED").when(F.col("n_best") == 1, "RESOLVED").otherwise("CONFLICT")
    done = found.withColumn("status", status).withColumn("value", F.when(F.col("status") == "RESOLVED", F.col("v")))
    return done.select(id_column, "field", "status", "value", F.when(F.col("status") == "RESOLVED", F.round(F.col("best") / PARSER, 2)).otherwise(0.0).alias("confidence"), "n_candidates")


def field_matrix(resolved: DataFrame, n_documents: int) -> DataFrame:
    """Per field: presence, resolution, conflicts, distinct values, confidence, and where to store it."""
    m = resolved.groupBy("field").agg(
        F.count("*").alias("present"), F.count_if(F.col("status") == "RESOLVED").alias("resolved"), F.count_if(F.col("status") == "CONFLICT").alias("conflicts"), F.count_distinct("value").alias("distinct_values"), F.round(F.avg("confidence"), 4).alias("avg_confidence")
    )
    share = F.col("resolved") / F.lit(max(1, n_documents))
    return m.withColumn("presence", F.round(F.col("present") / F.lit(max(1, n_documents)), 6)).withColumn("advice", F.when((share >= 0.8) & (F.col("distinct_values") <= 50), "FILTER_COLUMN").when(share >= 0.3, "JSON_FIELD").otherwise("IGNORE"))

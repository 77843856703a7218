"""Page geometry: words to lines, reading order, headings, table suppression and scanned pages.

Inputs are tables of words and objects with their boxes, whatever extractor made them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_TOLERANCE, COLUMN_GAP, FULL_WIDTH = 3.0, 0.08, 0.9
OWN_PAD, OVERLAP = 1.5, 0.7
LEGAL_HEADING = r"^第[一二三四五六七八九十百千万零〇两0-9]+[章节编篇部卷]"
LIST_PREFIX = r"^([一二三四五六七八九十百千万零〇两]+[、.．]\s|[（(][一二三四五六七八九十百千万零〇两]+[)）]|[0-9]+[.、．]\s|[（(][0-9]+[)）]|[•◦▪‣⁃·]\s)"


def _lines(pdf: pd.DataFrame, tolerance: float, gap: float) -> pd.DataFrame:
    words = pdf[pdf["text"].fillna("").str.strip() != ""].copy()
    words["cy"], words["cx"] = (words["y0"] + words["y1"]) / 2, (words["x0"] + words["x1"]) / 2
    words = words.sort_values(["cy", "cx"], kind="stable")
    line, start, ids = -1, None, []
    for cy in words["cy"]:
        if start is None or cy - start > tolerance:
            line, start = line + 1, cy
        ids.append(line)
    words["line"] = ids
    words = words.sort_values(["line", "x0"], kind="stable")
    out = words.groupby("line", sort=True).agg(x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"), font_size=("font_size", "max"), bold=("bold", "max"), text=("text", " ".join), width=("width", "first")).reset_index(drop=True)
    out["cx"], out["cy"] = (out["x0"] + out["x1"]) / 2, (out["y0"] + out["y1"]) / 2
    full = (out["x1"] - out["x0"]) > FULL_WIDTH * out["width"]
    centres = sorted(set(out.loc[~full, "cx"].round(1)))
    breaks = [(a + b) / 2 for a, b in zip(centres, centres[1:]) if len(out) and b - a >= gap * out["width"].iloc[0]]
    out["column"] = [0 if f else sum(c >= b for b in breaks) + 1 for f, c in zip(full, out["cx"])]
    # a full-width line ends a band; inside a band columns are read one after the other
    out = out.sort_values(["cy", "x0"], kind="stable")
    out["band"] = (out["column"] == 0).cumsum() * 2 - (out["column"] == 0)
    out = out.sort_values(["band", "column", "cy", "x0"], kind="stable").reset_index(drop=True)
    out["line_no"] = range(len(out))
    out.insert(0, "page", pdf["page"].iloc[0])
    out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
    return out[["doc_id", "page", "line_no", "column", "x0", "y0", "x1", "y1", "font_size", "bold", "text"]].astype({"line_no": "int32", "column": "int32"})


def lines_of_words(words: DataFrame, tolerance: float = LINE_TOLERANCE, gap: float = COLUMN_GAP) -> DataFrame:
    """Lines in reading order of each page's words (W13, P1); blank words fall out, one page is one group.

    ``words``: doc_id, page, x0, y0, x1, y1, text, font_size, bold, width.
    """
    rows = words.select("doc_id", "page", *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1", "font_size", "width")], "text", F.coalesce("bold", F.lit(False)).alias("bold")).filter(F.trim("text") != "")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, page {dict(rows.dtypes)['page']}, line_no int, column int, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean, text string"
    return rows.groupBy("doc_id", "page").applyInPandas(lambda pdf: _lines(pdf, tolerance, gap), schema)


def classify_lines(lines: DataFrame) -> DataFrame:
    """Type and heading level of each line by legal marks, font size against the page's median, and weight."""
    page = Window.partitionBy("doc_id", "page")
    sized = lines.withColumn("median", F.percentile("font_size", 0.5).over(page)).withColumn("largest", F.max("font_size").over(page))
    t = F.trim("text")
    legal = t.rlike(LEGAL_HEADING)
    listed = t.rlike(LIST_PREFIX) & ~t.rlike(r"^第[一二三四五六七八九十百千万零〇两0-9]+条")
    bigger = F.when(F.col("font_size") >= F.col("median") + 2.0, 1.6).when(F.col("font_size") >= F.col("median") + 1.0, 0.8).otherwise(0.0)
    score = F.when(legal, 2.0).otherwise(0.0) + bigger + F.when(F.col("bold") & (F.length(t) <= 40), 0.6).otherwise(0.0)
    heading = ~listed & ((score >= 2.0) | legal)
    level = F.when(F.col("font_size") < F.col("largest") - 3.0, 3).when(F.col("font_size") < F.col("largest") - 0.5, 2).otherwise(1)
    return sized.withColumn("type", F.when(listed, "LIST_ITEM").when(heading, "HEADING").otherwise("PARAGRAPH")).withColumn("level", F.when(heading, level)).drop("median", "largest")


def overlap_ratio(a: str, b: str) -> Column:
    """Intersection over union of two boxes with prefixed columns."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}_{hi}"), F.col(f"{b}_{hi}")) - F.greatest(F.col(f"{a}_{lo}"), F.col(f"{b}_{lo}")))
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    shared = side("x0", "x1") * side("y0", "y1")
    return F.when(area(a) + area(b) - shared > 0, shared / (area(a) + area(b) - shared)).otherwise(0.0)


def suppress_overlapping(boxes: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Boxes without those that overlap a better one of their page (J16): doc_id, page, box_id, score, x0, y0, x1, y1."""
    side = lambda p: boxes.select("doc_id", "page", *[F.col(c).alias(f"{p}_{c}") for c in ("box_id", "score", "x0", "y0", "x1", "y1")])
    better = (F.col("b_score") > F.col("a_score")) | ((F.col("b_score") == F.col("a_score")) & (F.col("b_box_id") < F.col("a_box_id")))
    beaten = side("a").join(side("b"), ["doc_id", "page"]).filter(better & (overlap_ratio("a", "b") >= least)).select("doc_id", "page", F.col("a_box_id").alias("box_id")).distinct()
    return boxes.join(beaten, ["doc_id", "page", "box_id"], "left_anti")


def lines_outside(lines: DataFrame, boxes: DataFrame, pad: float = OWN_PAD) -> DataFrame:
    """Lines whose centre lies in no padded box of their page, for a table owns the words inside it."""
    b = boxes.select("doc_id", "page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    owned = lines.join(b, ["doc_id", "page"]).filter(cx.between(F.col("b_x0") - pad, F.col("b_x1") + pad) & cy.between(F.col("b_y0") - pad, F.col("b_y1") + pad)).select("doc_id", "page", "line_no").distinct()
    return lines.join(owned, ["doc_id", "page", "line_no"], "left_anti")


def scanned(pages: DataFrame) -> DataFrame:
    """Whether a page is an image without usable text.

    ``pages``: doc_id, page, n_chars, n_words, image_share, n_images, n_rects, n_rules.
    """
    c = F.col
    empty = (c("n_chars") == 0) & (c("n_words") == 0)
    sparse = (c("n_chars") < 40) | (c("n_words") < 8) & (c("n_chars") == 0)
    image = (c("image_share") >= 0.35) | ((c("n_images") >= 2) & (c("n_chars") < 15)) | (empty & (c("n_rects") >= 200)) | (empty & (c("n_rules") >= 2000)) | (empty & (c("n_rects") + c("n_rules") >= 40) & (c("n_images") >= 1))
    return pages.withColumn("scanned", F.coalesce(sparse & image, F.lit(False)))

"""Line cleaner for legal corpora: one action column over exploded lines, then the documents rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import collapse_ws, strip

REVIEW_RATIO, REVIEW_CHARS = 0.30, 50
BOUNDARY_LINES, BOUNDARY_SHARE, BOUNDARY_PAGES = 3, 0.60, 4
PLACEHOLDER = "[待填写]"

# fixed values: lines that are page furniture as a whole
EXACT_LINES = ["JiaThis Button BEGIN", "JiaThis Button END", "Baidu Button BEGIN", "Baidu Button END", "二维码生成专用", "扫一扫在手机打开当前页", "扫一扫在手机上打开当前页", "关闭窗口", "打印", "返回顶部", "侧边栏飘窗", "footer", "header"]
# fixed values: beginnings of furniture lines
PREFIXES = ["start component HTML组件", "end component HTML组件", "JiaThis Button", "Baidu Button"]
# fixed values: patterns of furniture lines
PATTERNS = [
    r"^二维码生成专用", r"^扫一扫在手机(上)?打开当前页", r"^(分享到|一键分享|分享按钮|分享至)([^\p{L}\p{N}_]|$)", r"^(上一篇|下一篇)\s*[:：]", r"^责任编辑\s*[:：]", r"javascript\s*:", r"^\|[\s|]*(打印|关闭窗口|纠错|分享|收藏|返回顶部)[\s|]*$",
    r"Produced By CMS", r"网站群内容管理系统", r"publishdate\s*:", r"返回顶部", r"侧边栏飘窗", r"^[-*]\s*[一-鿿A-Za-z0-9]+\s*◆+\s*◆+$", r"京ICP备", r"京公网安备", r"版权所有", r"^PC版$", r"(?i)^(start|end)\s+component(\s+.*)?$",
    r"(?i)^(\[[^\]]*\]\()?https?://(www\.)?jiathis\.com(/[^\s)]*)?\)?$", r"(?i)^[-_=~—–─]{3,}\s*baidu\s*[-_=~—–─]{3,}$",
]
# fixed values: cells of navigation rows
JUNK_CELLS = ["打印", "关闭窗口", "纠错", "分享", "收藏", "返回顶部", "上一篇", "下一篇", ""]
SEPARATOR = r"^[\s_＿\-—–・─=~．.•·]{3,}$"
PAGE_NUMBERS = [r"^第\s*\d+\s*页\s*/\s*共\s*\d+\s*页$", r"^第\s*\d+\s*页$", r"^[—\-–]\s*\d+\s*[—\-–]$"]
FIELD_BLANK = r"^([一-鿿A-Za-z0-9（）()【】\[\]、，,.:：·\-/]+)\s*[：:]\s*[_＿]{2,}$"
LABEL_BLANK = r"^([一-鿿A-Za-z0-9（）()【】]+)\s*[_＿]{2,}$"
DATE_BLANK = r"^[_＿\s]*年[_＿\s]*月[_＿\s]*日[_＿\s]*$"
RESIDUE = r"(?i)jiathis\.com|JiaThis\s+Button|二维码生成专用|Produced\s+By\s+CMS|访问量统计|网站群内容管理系统|publishdate\s*:"


def any_match(line: Column, patterns: list[str]) -> Column:
    """One alternation instead of a chain of matches, so a line is scanned once."""
    return line.rlike("|".join(f"(?:{p})" for p in patterns))


def junk_row(line: Column) -> Column:
    """A Markdown row of nothing but navigation cells."""
    cells = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), strip)
    return line.startswith("|") & line.endswith("|") & F.exists(cells, lambda c: c != "") & F.forall(cells, lambda c: c.isin(JUNK_CELLS))


def line_action(line: Column, placeholders: Column) -> Column:
    """``blank``, ``boilerplate``, ``page_number``, ``separator``, ``placeholder`` or ``keep``; the first that holds."""
    s = strip(line)
    furniture = s.isin(EXACT_LINES) | any_match(s, [rf"^\Q{p}\E" for p in PREFIXES] + PATTERNS) | junk_row(s)
    return (
        F.when(s == "", "blank")
        .when(furniture, "boilerplate")
        .when(any_match(s, PAGE_NUMBERS), "page_number")
        .when(s.rlike(SEPARATOR), "separator")
        .when(placeholders & any_match(s, [DATE_BLANK, FIELD_BLANK, LABEL_BLANK]), "placeholder")
        .otherwise("keep")
    )


def fill_placeholder(line: Column) -> Column:
    s = strip(line)
    label = lambda p: F.concat(strip(F.regexp_extract(s, p, 1)), F.lit("：" + PLACEHOLDER))
    return F.when(s.rlike(DATE_BLANK), "日期：" + PLACEHOLDER).when(s.rlike(FIELD_BLANK), label(FIELD_BLANK)).otherwise(label(LABEL_BLANK))


def classify_lines(documents: DataFrame, id_column: str = "doc_id", text: str = "text", placeholders: bool = True) -> DataFrame:
    """One row a line: its number, text, action and cleaned text (null where removed). Null texts have no line."""
    rows = documents.select(id_column, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    acted = rows.withColumn("action", line_action(F.col("line"), F.lit(placeholders)))
    return acted.withColumn("cleaned", F.when(F.col("action") == "placeholder", fill_placeholder(F.col("line"))).when(F.col("action").isin("blank", "keep"), F.col("line")))


def clean_documents(documents: DataFrame, id_column: str = "doc_id", text: str = "text", placeholders: bool = True) -> DataFrame:
    """Cleaned texts with their counts, hash and gate (G17, line cleaner).

    The gate asks for review where too much went, little is left, or furniture remains. A row stays one row: the lines
    are handled as an array inside it, so nothing is shuffled and a long text meets no other row.
    """
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    tagged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_action(x, F.lit(placeholders)).alias("action")))
    kept = F.transform(F.filter("tagged", lambda t: t["action"].isin("blank", "keep", "placeholder")), lambda t: F.when(t["action"] == "placeholder", fill_placeholder(t["line"])).otherwise(t["line"]))
    count = lambda *actions: F.size(F.filter("tagged", lambda t: t["action"].isin(*actions)))
    rows = documents.filter(F.col(text).isNotNull()).select(id_column, F.length(text).alias("raw_chars"), tagged.alias("tagged"))
    cleaned = rows.select(id_column, "raw_chars", collapse_ws(F.array_join(kept, "\n")).alias("clean_text"), count("boilerplate", "page_number").alias("boilerplate_hits"), count("separator").alias("low_info_removed"), count("placeholder").alias("placeholders"))
    ratio = F.when(F.col("raw_chars") > 0, F.round((F.col("raw_chars") - F.length("clean_text")) / F.col("raw_chars"), 6)).otherwise(0.0)
    measured = cleaned.withColumn("clean_chars", F.length("clean_text")).withColumn("removed_ratio", ratio).withColumn("normalized_sha256", F.sha2("clean_text", 256))
    poor = (F.col("removed_ratio") >= REVIEW_RATIO) | ((F.col("raw_chars") > 0) & (F.col("clean_chars") < REVIEW_CHARS)) | F.col("clean_text").rlike(RESIDUE)
    return measured.withColumn("quality_status", F.when(poor, "NEEDS_REVIEW").otherwise("PASS"))


def repeated_boundaries(pages: DataFrame, id_column: str = "doc_id", lines: int = BOUNDARY_LINES, share: float = BOUNDARY_SHARE, min_pages: int = BOUNDARY_PAGES) -> DataFrame:
    """Lines at the same place near the top or bottom of most pages of a document.

    ``pages``: id, page_no, line_no, n_lines, line. A line that is both near the top and the bottom counts for the top.
    """
    s = strip("line")
    placed = pages.select(id_column, "page_no", s.alias("line"), F.when(F.col("line_no") < lines, F.struct(F.lit("top").alias("side"), F.col("line_no").alias("position"))).when(F.col("n_lines") - F.col("line_no") <= lines, F.struct(F.lit("bottom").alias("side"), (F.col("n_lines") - F.col("line_no") - 1).alias("position"))).alias("p")).filter(F.col("p").isNotNull() & (F.col("line") != ""))
    total = pages.groupBy(id_column).agg(F.count_distinct("page_no").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    counts = placed.select(id_column, "page_no", "line", "p.side", "p.position").distinct().groupBy(id_column, "side", "position", "line").agg(F.count("*").alias("n_on"))
    return counts.join(total, id_column).filter(F.col("n_on") >= share * F.col("n_pages"))


def forward_fill(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column's last value that is not null, up to the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})

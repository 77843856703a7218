"""Files as rows: dispatch by suffix, text, Markdown with front matter, DOCX, XLSX, manifests, checks of uploads."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = [("txt", True, "text"), ("md", True, "markdown"), ("docx", True, "zip and XML"), ("pdf", False, "needs an optional library"), ("doc", False, "needs an office converter"), ("xlsx", True, "zip and XML")]
MAX_UPLOAD = 20 * 1024 * 1024
MIN_ATTACHMENT, MAX_ATTACHMENT = 10, 60_000
#: Keys kept of a Markdown file's front matter.
FRONT_KEYS = ["doc_id", "title", "category", "status", "source", "source_org", "publish_date", "effective_date", "document_number", "jurisdiction", "language", "version"]
QUESTION_NAMES, ANSWER_NAMES = ["question", "问题", "q", "标准问题"], ["answer", "答案", "a", "回答"]
MANIFEST = "logical_document_id string, title string, canonical_file string, format string, canonical boolean, cleaning_status string, normalized_sha256 string, _corrupt_record string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def capabilities(spark: SparkSession) -> DataFrame:
    """Which file kinds can be read here."""
    return spark.createDataFrame(SUFFIXES, "suffix string, available boolean, by string")


def crawl(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder with suffix, size, hash and a status.

    Unsupported suffixes and names that occur twice, whatever their case, are marked, not dropped; files of no bytes are
    not listed by Spark.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    hashed = named.select("path", "name", "suffix", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
    copies = hashed.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n_same_name"))
    known = [s for s, ok, _ in SUFFIXES if ok]
    status = F.when(~F.col("suffix").isin([s for s, _, _ in SUFFIXES]), "UNSUPPORTED_FILE_TYPE").when(~F.col("suffix").isin(known), "PARSER_UNAVAILABLE").when(F.col("n_same_name") > 1, "DUPLICATE_NAME").otherwise("OK")
    return hashed.join(copies, F.lower("name") == F.col("key")).select("path", "name", "suffix", "length", "modificationTime", "sha256", status.alias("status"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 text files as ``path``, ``text`` and ``status``; a byte-order mark and outer whitespace are cut (S3)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    stripped = F.regexp_replace(text, r"^\s+|\s+\z", "")
    return rows.select("path", F.when(valid, stripped).alias("text"), F.when(~valid, "INVALID_ENCODING").when(stripped == "", "EMPTY_DOCUMENT").otherwise("OK").alias("status"))


def front_matter(text: Column) -> Column:
    """Struct of a Markdown text's front matter block, its body, and whether the block is closed."""
    opened = text.rlike(r"^---[ \t]*\r?\n")
    closed = text.rlike(r"(?s)^---[ \t]*\r?\n.*?\r?\n---[ \t]*(\r?\n|\z)")
    block = F.regexp_extract(text, r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(\r?\n|\z)", 1)
    body = F.when(closed, F.regexp_replace(text, r"(?s)^---[ \t]*\r?\n.*?\r?\n---[ \t]*(\r?\n|\z)", "")).otherwise(text)
    return F.struct(F.when(closed, block).alias("block"), body.alias("body"), (~opened | closed).alias("valid"))


def front_fields(block: Column) -> Column:
    """Map of the whitelisted ``key: value`` lines of a front matter block."""
    pairs = F.transform(F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]+\s*:")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[A-Za-z_]+\s*:", "")), r"""^["']|["']$""", "").alias("value")))
    kept = F.filter(pairs, lambda p: p["key"].isin(FRONT_KEYS) & (p["value"] != ""))
    names = F.array_distinct(F.transform(kept, lambda p: p["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(kept, lambda p: p["key"] == k), 1)["value"]))


def _runs(node: ET.Element) -> str:
    """Text of a paragraph with insertions and without deletions."""
    out = []
    for x in node:
        if x.tag == _W + "del":
            continue
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag in (_W + "tab", _W + "br"):
            out.append("\t" if x.tag == _W + "tab" else "\n")
        else:
            out.append(_runs(x))
    return "".join(out)


def docx_blocks(raw: bytes) -> list[tuple[str, str, int | None]]:
    """Blocks of a DOCX body in order: type, text, heading level; tables as Markdown with spanned cells padded."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(_W + "body")
    out: list[tuple[str, str, int | None]] = []
    for x in body if body is not None else ():
        if x.tag == _W + "p":
            text = _runs(x).strip()
            style = x.find(f"{_W}pPr/{_W}pStyle")
            outline = x.find(f"{_W}pPr/{_W}outlineLvl")
            name = style.get(_W + "val", "") if style is not None else ""
            named = re.match(r"(?:heading|标题)\s*(\d)", name, re.I)
            level = int(named.group(1)) if named else int(outline.get(_W + "val", "0")) + 1 if outline is not None else 1 if re.match(r"第[一二三四五六七八九十百]+[章编]", text) else None
            if text:
                out.append(("HEADING" if level else "LIST_ITEM" if x.find(f"{_W}pPr/{_W}numPr") is not None else "PARAGRAPH", text, level))
        elif x.tag == _W + "tbl":
            rows = []
            for tr in x.iter(_W + "tr"):
                row: list[str] = []
                for tc in tr.findall(_W + "tc"):
                    span, merge = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
                    text = " ".join(filter(None, (_runs(p).strip() for p in tc.iter(_W + "p"))))
                    if merge is not None and merge.get(_W + "val") != "restart" and rows and len(row) < len(rows[-1]):
                        text = rows[-1][len(row)]
                    row += [text] + [""] * (int(span.get(_W + "val", "1")) - 1 if span is not None else 0)
                rows.append(row)
            width = max(map(len, rows), default=0)
            cells = [[c.replace("|", "\\|").replace("\n", "<br>") for c in r + [""] * (width - len(r))] for r in rows]
            if width:
                lines = ["| " + " | ".join(r) + " |" for r in cells]
                out.append(("TABLE", "\n".join([lines[0], "| " + " | ".join("-" * max(3, len(c)) for c in cells[0]) + " |", *lines[1:]]), None))
    return out


def xlsx_rows(raw: bytes) -> list[list[str]]:
    """Rows of the first sheet of a workbook as strings, blank cells empty."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    sheet = ET.fromstring(z.read(sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n))[0]))
    out = []
    for row in sheet.iter(_S + "row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.findall(_S + "c")):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters.group()))) - 1 if letters else k
            value, inline = c.find(_S + "v"), c.find(_S + "is")
            text = "".join(t.text or "" for t in inline.iter(_S + "t")) if inline is not None else (value.text or "") if value is not None else ""
            cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
        out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return out


def faq_rows(rows: list[list[str]]) -> list[tuple[str, str]]:
    """Question and answer pairs of a sheet whose first row names the columns; pairs with a blank side fall out."""
    if not rows:
        return []
    head = [h.strip().lower() for h in rows[0]]
    q = next((k for k, h in enumerate(head) if h in QUESTION_NAMES), None)
    a = next((k for k, h in enumerate(head) if h in ANSWER_NAMES), None)
    if q is None or a is None:
        raise ValueError("no question and answer columns")
    get = lambda r, k: r[k].strip() if k < len(r) else ""
    return [(get(r, q), get(r, a)) for r in rows[1:] if get(r, q) and get(r, a)]


def _per_file(read, types: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    got = [(path, k, *row, None) for k, row in enumerate(read(raw))]
                    out += got or [(path, 0, *[None] * len(types), "EMPTY_DOCUMENT")]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError) as broken:
                    out.append((path, 0, *[None] * len(types), f"PARSE_FAILED: {type(broken).__name__}"))
            names = ["path", "order", *[n for n, _ in types], "error"]
            kinds = [pa.string(), pa.int32(), *[t for _, t in types], pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return run


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of DOCX files; a file that can't be read is one row with its error."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "content").mapInArrow(_per_file(docx_blocks, [("type", pa.string()), ("text", pa.string()), ("level", pa.int32())]), "path string, order int, type string, text string, level int, error string")


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    """Question and answer pairs of XLSX files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "content").mapInArrow(_per_file(lambda raw: faq_rows(xlsx_rows(raw)), [("question", pa.string()), ("answer", pa.string())]), "path string, order int, question string, answer string, error string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records of a JSON-lines manifest; a line that is no record, or no canonical record at all, is an error."""
    rows = spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad, good = rows.agg(F.count("_corrupt_record"), F.count_if(F.col("canonical"))).first()
    if bad or not good:
        raise ValueError(f"manifest: {bad} lines are no records, {good} records are canonical")
    return rows.filter("canonical").drop("_corrupt_record")


def upload_status(name: Column, length: Column) -> Column:
    """Why an upload is refused, or OK."""
    plain = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    return F.when(F.coalesce(F.trim(plain), F.lit("")) == "", "INVALID_NAME").when(~F.lower(F.regexp_extract(plain, r"\.([^.]+)$", 1)).isin([s for s, _, _ in SUFFIXES]), "UNSUPPORTED_FILE_TYPE").when(F.coalesce(length, F.lit(0)) <= 0, "EMPTY_FILE").when(length > MAX_UPLOAD, "FILE_TOO_LARGE").otherwise("OK")


def image_kind(content: Column) -> Column:
    """MIME type by the first bytes of a binary, null for no known image."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")


def attachment_text(text: Column) -> Column:
    """An attachment's usable text, cut to its limit; null where it is too short or holds placeholders alone."""
    body = F.trim(F.regexp_replace(text, r"\[(图片|image|扫描页|待识别)[^\]]*\]", ""))
    return F.when(F.length(body) >= MIN_ATTACHMENT, F.substring(F.trim(text), 1, MAX_ATTACHMENT))

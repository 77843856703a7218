import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.operators import blocks
from lexweave.sources import files, sinks
from lexweave.streaming import events


def test_markdown_blocks_and_structure(spark):
    text = "# 总则\n第一段\n续行\n\n- 一项\n## 第一章 附则\n### 第一节 甲\n第一条 文\n\n第二章 乙\n\n后文"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = blocks.markdown_blocks(rows)
    assert [(r["type"], r["level"], r["text"]) for r in got.orderBy("order").collect()] == [
        ("HEADING", 1, "总则"), ("PARAGRAPH", None, "第一段\n续行"), ("LIST_ITEM", None, "- 一项"), ("HEADING", 2, "第一章 附则"), ("HEADING", 3, "第一节 甲"), ("PARAGRAPH", None, "第一条 文"), ("PARAGRAPH", None, "第二章 乙"), ("PARAGRAPH", None, "后文"),
    ]
    places = {r["order"]: (r["chapter"], r["section"], r["article"]) for r in blocks.sticky_structure(got).collect()}
    assert places[5] == ("第一章", "第一节", "第一条") and places[7] == ("第二章", None, None) and places[0] == (None, None, None)
    assert blocks.structure_chunks(got).filter("article = '第一条'").first()["content"].endswith("第一条 文")
    assert blocks.dominant_type(got, ["doc_id"]).first()["dominant_type"] == "PARAGRAPH"


def test_block_cleaner_rules(spark):
    texts = [
        ("PARAGRAPH", "打印"), ("HEADING", "河道条例"), ("PARAGRAPH", "河道条例"), ("PARAGRAPH", "发文机关："), ("PARAGRAPH", "某市人民政府"), ("PARAGRAPH", "上一篇：当事人应当遵守合同约定的全部义务和责任"), ("PARAGRAPH", "——————"), ("PARAGRAPH", "第 3 页"), ("TABLE", "打印"),
        ("UNKNOWN", "打印"), ("PARAGRAPH", "第三条 正文应当保留。"), ("PARAGRAPH", "第三条 正文应当保留。"), ("PARAGRAPH", "正"), ("PARAGRAPH", "第三条 正文应当保留。"), ("PARAGRAPH", "https://example.com/x"), ("METADATA", "索引号：0001"), ("PARAGRAPH", None),
    ]
    rows = spark.createDataFrame([(1, k, t, 1 if t == "HEADING" else None, x, "html") for k, (t, x) in enumerate(texts)], "doc_id int, order int, type string, level int, text string, format string")
    got = {r["order"]: (r["action"], r["rule_id"]) for r in blocks.clean_blocks(rows).collect()}
    assert len(got) == len(texts)
    assert got[0][0] == "DROP" and got[2] == ("DEDUPLICATE", "DEDUP_LOCAL") and got[3] == ("MOVE_METADATA", "MOVE_ADJACENT_KEY") and got[5] == ("REVIEW", "DROP_NAVIGATION")
    assert [got[k][0] for k in (6, 7, 8, 9, 10, 11, 12, 13, 14, 15)] == ["DROP", "DROP", "REVIEW", "REVIEW", "KEEP", "DEDUPLICATE", "REVIEW", "KEEP", "DROP", "MOVE_METADATA"]
    pages = [(2, k, "PARAGRAPH", None, x, "pdf") for k, x in enumerate(["正文", "1", "2", "3", "4", "第3条"])]
    pdf = {r["order"]: r["action"] for r in blocks.clean_blocks(spark.createDataFrame(pages, rows.schema)).collect()}
    assert [pdf[k] for k in range(6)] == ["REVIEW", "DROP", "DROP", "DROP", "DROP", "KEEP"]
    assert blocks.rebuild(blocks.clean_blocks(rows)).agg(F.max("order")).first()[0] == sum(a in ("KEEP", "MOVE_METADATA", "REVIEW") for a, _ in got.values()) - 1


def test_packing_pages_and_recursive_split():
    assert blocks.pack_pages(["a" * 900, "", None, "b" * 800, "c" * 900]) == [(1, 4, 0, "a" * 900 + "\n" + "b" * 800), (5, 5, 0, "c" * 900)]
    assert [len(t) for *_, t in blocks.pack_pages(["x" * 4000])] == [3600, 400]
    text = "第一句。" * 100 + "\n\n" + "长" * 2000
    pieces = blocks.split_recursively(text)
    assert all(len(p) <= 900 for p in pieces) and "".join(pieces).replace("\n", "") == text.replace("\n", "")


def test_text_front_matter_and_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿ 正文 \n".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.txt").write_bytes(b"  ")
    got = {r["path"][-5:]: (r["text"], r["status"]) for r in files.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("正文", "OK"), "b.txt": (None, "INVALID_ENCODING"), "c.txt": ("", "EMPTY_DOCUMENT")}
    doc = F.lit("---\ntitle: '标题'\nunknown: x\nstatus: active\n---\n正文")
    row = spark.range(1).select(files.front_matter(doc).alias("m"), files.front_matter(F.lit("---\ntitle: x\n正文")).alias("open")).select("m", "open", files.front_fields(F.col("m.block")).alias("f")).first()
    assert row["m"]["body"] == "正文" and row["f"] == {"title": "标题", "status": "active"} and not row["open"]["valid"]
    status = lambda n, size: spark.range(1).select(files.upload_status(F.lit(n), F.lit(size))).first()[0]
    assert [status(*x) for x in (("a/b.PDF", 5), ("x.exe", 5), ("x.md", 0), ("x.md", 1 << 30), ("", 4))] == ["OK", "UNSUPPORTED_FILE_TYPE", "EMPTY_FILE", "FILE_TOO_LARGE", "INVALID_NAME"]
    kind = lambda b: spark.createDataFrame([(bytearray(b),)], "b binary").select(files.image_kind(F.col("b"))).first()[0]
    assert [kind(x) for x in (b"\xff\xd8\xff\xe0aaaaaaaa", b"\x89PNG\r\n\x1a\n0000", b"RIFF1234WEBP", b"GIF89a")] == ["image/jpeg", "image/png", "image/webp", None]
    assert spark.range(1).select(files.attachment_text(F.lit("[图片1]"))).first()[0] is None


def test_crawl_marks_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.md", b"x"), ("sub/A.MD", b"y"), ("b.xyz", b"z"), ("d.doc", b"q")):
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r["status"] for r in files.crawl(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "DUPLICATE_NAME", "A.MD": "DUPLICATE_NAME", "b.xyz": "UNSUPPORTED_FILE_TYPE", "d.doc": "PARSER_UNAVAILABLE"}


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


def test_docx_and_xlsx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, extra="": f"<w:p>{extra}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t)}</w:tc>"
    body = p("标题", '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>') + "<w:p><w:r><w:t>留</w:t></w:r><w:del><w:r><w:t>删</w:t></w:r></w:del><w:ins><w:r><w:t>增</w:t></w:r></w:ins></w:p>" + p("项", "<w:pPr><w:numPr/></w:pPr>")
    body += f'<w:tbl><w:tr>{cell("甲", chr(60) + "w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}{cell("a|b")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("c")}</w:tr><w:tr>{cell("合", chr(60) + "w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr></w:tbl>'
    (tmp_path / "x.docx").write_bytes(archive(word__document_xml=f"<w:document {w}><w:body>{body}</w:body></w:document>"))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    rows = files.read_docx(spark, str(tmp_path)).orderBy("path", "order").collect()
    assert rows[0]["error"].startswith("PARSE_FAILED") and [(r["type"], r["text"], r["level"]) for r in rows[1:4]] == [("HEADING", "标题", 2), ("PARAGRAPH", "留增", None), ("LIST_ITEM", "项", None)]
    assert rows[4]["text"] == "| 甲 | a\\|b |\n| --- | ---- |\n| 甲 | c |\n| 合 |  |"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Answer</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row><row><c r="A3" t="s"><v>1</v></c></row></sheetData></worksheet>'
    (tmp_path / "faq.xlsx").write_bytes(archive(xl__sharedStrings_xml=f"<sst {s}><si><t>问题</t></si><si><t>多少</t></si></sst>", xl__worksheets__sheet1_xml=sheet))
    assert [(r["question"], r["answer"], r["error"]) for r in files.read_faq(spark, str(tmp_path)).collect()] == [("多少", "5", None)]


def test_manifest_is_fail_closed(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"logical_document_id":"a","canonical":true}\n{"logical_document_id":"b","canonical":false}\n', encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text('{"logical_document_id":"a","canonical":true}\nnot json\n', encoding="utf-8")
    assert [r["logical_document_id"] for r in files.read_manifest(spark, str(tmp_path / "ok.jsonl")).collect()] == ["a"]
    with pytest.raises(ValueError, match="1 lines"):
        files.read_manifest(spark, str(tmp_path / "bad.jsonl"))


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path)
    sinks.append_rows(spark.createDataFrame([(3, "c")], "k int, v string"), path)
    sinks.delete_keys(spark, path, spark.createDataFrame([(1,)], "k int"), "k")
    spark.catalog.clearCache()
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [2, 3]
    one = spark.createDataFrame([(1,)], "k int")
    assert [sinks.sync_package(one, one, one, str(tmp_path / "pkg")) for _ in range(2)] == [1, 2]
    with pytest.raises(ValueError):
        sinks.sync_package(one.limit(0), one, one, str(tmp_path / "pkg"))
    sinks.write_deliverables(one, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/csv")).count() == 1


def test_streaming_rate_limit_keeps_state_between_batches(spark, tmp_path):
    t0, schema = dt.datetime(2024, 1, 1), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    source, out = tmp_path / "in", str(tmp_path / "out")
    for k, seconds in enumerate([[0, 1], [2, 100]]):
        spark.createDataFrame([(10 * k + n, t0 + dt.timedelta(seconds=s), 1, "view", 1.0) for n, s in enumerate(seconds)], schema).coalesce(1).write.mode("append").parquet(str(source))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)).withColumn("ts", F.col("ts").cast("timestamp"))
    query = events.rate_limit_stream(rows, limit=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    assert got.keys() == {0, 1, 10, 11} and got[11] and sum(got.values()) == 3

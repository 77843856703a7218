from pyspark.sql import functions as F

from lexweave.operators import answers, geometry

WORD = "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, bold boolean, width double"


def floats(rows):
    return [(r[0], r[1], *map(float, r[2:6]), *r[6:]) for r in rows]


def test_lines_and_reading_order(spark):
    words = [(1, 1, 0, 0, 590, 10, "第一章 总则", 16.0, True, 600.0), (1, 1, 10, 20, 60, 30, "左一", 10.0, None, 600.0), (1, 1, 70, 21, 120, 31, "左续", 10.0, None, 600.0), (1, 1, 400, 20, 500, 30, " ", 10.0, None, 600.0)]
    words += [(1, 1, 10, 40, 120, 50, "左二", 10.0, None, 600.0), (2, 1, 10, 0, 50, 10, "1. 项", 10.0, False, 600.0)]
    got = geometry.lines_of_words(spark.createDataFrame(floats(words), WORD))
    assert [r["text"] for r in got.filter("doc_id = 1").orderBy("line_no").collect()] == ["第一章 总则", "左一 左续", "左二"]
    kinds = {r["text"]: (r["type"], r["level"]) for r in geometry.classify_lines(got).collect()}
    assert kinds == {"第一章 总则": ("HEADING", 1), "左一 左续": ("PARAGRAPH", None), "左二": ("PARAGRAPH", None), "1. 项": ("LIST_ITEM", None)}
    two = [(3, 1, x, y, x + 100, y + 10, t, 10.0, False, 600.0) for t, x, y in (("a1", 10, 0), ("b1", 400, 20), ("a2", 10, 40), ("b2", 400, 60))]
    columns = geometry.lines_of_words(spark.createDataFrame(floats(two), WORD)).orderBy("line_no")
    assert [r["text"] for r in columns.collect()] == ["a1", "a2", "b1", "b2"]


def test_boxes_and_scans(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 0.5, 0.0, 0.0, 10.0, 9.0), (1, 1, 3, 0.5, 50.0, 0.0, 60.0, 9.0)], "doc_id int, page int, box_id int, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["box_id"] for r in geometry.suppress_overlapping(boxes).collect()) == [1, 3]
    lines = spark.createDataFrame([(1, 1, 0, 1.0, 1.0, 9.0, 9.0), (1, 1, 1, 20.0, 1.0, 30.0, 9.0)], "doc_id int, page int, line_no int, x0 double, y0 double, x1 double, y1 double")
    assert [r["line_no"] for r in geometry.lines_outside(lines, boxes).collect()] == [1]
    pages = [(1, 1, 5, 1, 0.9, 1, 0, 0), (1, 2, 900, 200, 0.9, 1, 0, 0), (1, 3, 0, 0, 0.0, 0, 0, 5000), (1, 4, None, None, None, None, None, None)]
    got = geometry.scanned(spark.createDataFrame(pages, "doc_id int, page int, n_chars int, n_words int, image_share double, n_images int, n_rects int, n_rules int"))
    assert [r["scanned"] for r in got.orderBy("page").collect()] == [True, False, True, False]


def test_answers(spark):
    asks = lambda q: spark.range(1).select(answers.asks_history(F.lit(q))).first()[0]
    assert [asks(q) for q in ("我一共问了几个问题？", "前 3 个问题是什么", "劳动合同如何解除？", "问", None)] == [True, True, False, False, False]
    spell = lambda v: spark.range(1).select(answers.needles(F.lit(v))).first()[0]
    assert spell("1200000") == ["1,200,000元", "1,200,000", "1200000"] and spell("0.13") == ["13%", "0.13"] and spell("2024-03-05") == ["2024-03-05", "2024年3月5日"] and spell(" ") == []
    truth = spark.createDataFrame([(1, ["d"], ["Tax"])], "query_id int, doc_keys array<string>, needles array<string>")
    hits = answers.ground_truth_hits(spark.createDataFrame([(1, 1, "e", "tax"), (1, 2, "d", "the tax"), (1, 3, "d", None)], "query_id int, rank int, doc_key string, text string"), truth)
    assert [(r["doc_hit"], r["hit"]) for r in hits.orderBy("rank").collect()] == [(False, False), (True, True), (True, False)]
    chunks = spark.createDataFrame([("d", "c1", "税率13%"), ("d", "c2", "无"), ("e", "c3", "13%")], "doc_key string, chunk_id string, content string")
    mapped = answers.citation_map(spark.createDataFrame([("d", "rate", ["13%", "0.13"])], "doc_key string, field string, needles array<string>"), chunks)
    assert mapped.first()["chunk_ids"] == ["c1"]
    a = spark.createDataFrame([(1, "a1", "xxxx", [1, 2]), (1, "a2", "x", [3])], "doc_id int, chunk_id string, content string, block_orders array<int>")
    assert answers.review_pairs(a, a, per_document=1).collect() == [(1, "a1", "a1")]


def test_ground_truth_needs_the_whole_passage(spark, tmp_path):
    from lexweave.plans import answers as plans

    passage = "The buyer pays the price before delivery."
    spark.createDataFrame([(1, "doc", passage)], "item_id long, target_doc string, passage string").write.parquet(str(tmp_path / "eval_items.parquet"))
    parents = [("doc@1", "a", "x " + passage.upper()), ("doc@1", "b", "The buyer pays later."), ("doc@1", "c", None)]
    spark.createDataFrame(parents, "document_identity string, external_parent_id string, content string").write.parquet(str(tmp_path / "legal_parent_contract_v1.parquet"))
    assert [tuple(r) for r in plans.ground_truth_hits(spark, str(tmp_path)).collect()] == [(1, 3, 1)]

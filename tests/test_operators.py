import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.operators import chunking, citations, cleaning, contract, evaluation, ingest, metadata, retrieval, state
from lexweave.sources import html


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_text_helpers(spark):
    assert one(spark, text.normalize_ws(F.lit("a \t\t b\r\n\n\n\nc　"))) == "a b\n\nc"
    assert one(spark, text.search_tokens(F.lit("第3条 Tax法"))) == ["第", "3", "条", "tax", "法"]
    assert [one(spark, text.normalize_date(F.lit(x))) for x in ("2024年3月5日 发布", "2024-02-30", "2023/2/29", "2020.11.3", "x")] == ["2024-03-05", None, "2023-02-29", "2020-11-03", None]
    assert one(spark, text.normalize_document_number(F.lit("国发 〔2020〕—1号"))) == "国发〔2020〕-1号"
    assert one(spark, text.words_only(F.lit("第三条 —9— a_b！"))) == "第三条a_b"
    assert one(spark, text.numeric_cell(F.lit("１，２３４.5万元"))) and not one(spark, text.numeric_cell(F.lit("1,23x")))
    table = one(spark, text.markdown_table(F.array(F.lit("a|b"), F.lit("c")), F.array(F.array(F.lit("1\n2"), F.lit(None).cast("string")))))
    assert table == "| a\\|b | c |\n| ---- | --- |\n| 1<br>2 |  |"
    assert one(spark, text.micros(F.expr("timestamp_ntz '1970-01-02 00:00:01.5'"))) == 86401500000


def test_windows_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "x" * 400, 5), (2, "", 5), (3, None, 5), (4, "y" * 50, 5)], "doc_id long, text string, start int")
    plain = chunking.child_windows(docs, window=100, overlap=20).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in plain] == [(1, 0, 100), (1, 80, 180), (1, 160, 260), (1, 240, 340), (1, 320, 400), (4, 0, 50)]
    stopping = chunking.child_windows(spark.createDataFrame([(1, "x" * 180)], "doc_id long, text string"), window=100, overlap=20, stop_at_end=True)
    assert stopping.count() == 2 and chunking.child_windows(spark.createDataFrame([(1, "x" * 180)], "doc_id long, text string"), window=100, overlap=20).count() == 3
    assert chunking.coverage(chunking.child_windows(docs, window=100, overlap=20), docs.select("doc_id", F.lit(400).alias("n")).filter("doc_id = 1")).first()["coverage_pct"] == 100.0
    ids = chunking.with_chunk_ids(chunking.child_windows(docs)).select("chunk_id").distinct().collect()
    assert all(len(r[0]) == 32 for r in ids)
    assert chunking.duplicate_ratio(spark.createDataFrame([(1, "abcdefgh" * 3), (2, "abcdefghijk")], "doc_id long, text string")).orderBy("doc_id").collect()[1][1] == 0.0


def test_tables_are_split_without_losing_rows(spark):
    rows = [[str(k), "v" * 60] for k in range(25)]
    parts = chunking.split_tables(spark.createDataFrame([(1, ["a", "b"], rows), (2, ["a", "b"], rows[:3])], "id int, headers array<string>, rows array<array<string>>")).orderBy("id", "part").collect()
    assert [len(p["rows"]) for p in parts] == [10, 10, 5, 3]


def test_line_cleaner(spark):
    lines = ["第一条 正文", "打印", "| 打印 | | 关闭窗口 |", "第 3 页", "- 12 -", "第三条", "——————", "甲方：____", "其他____", "__年__月__日", "责任编辑：某人", "（三）列举", ""]
    got = cleaning.classify_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).orderBy("line_no").collect()
    assert [r["action"] for r in got] == ["keep", "boilerplate", "boilerplate", "page_number", "page_number", "keep", "separator", "placeholder", "placeholder", "placeholder", "boilerplate", "keep", "blank"]
    assert [got[k]["cleaned"] for k in (7, 8, 9)] == ["甲方：[待填写]", "其他：[待填写]", "日期：[待填写]"]
    clean = cleaning.clean_documents(spark.createDataFrame([(1, "\n".join(lines)), (2, "正文" * 60), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["quality_status"] for r in clean] == ["NEEDS_REVIEW", "PASS"] and clean[0]["boilerplate_hits"] == 5 and clean[0]["clean_text"].startswith("第一条 正文\n第三条")


def test_repeated_boundaries(spark):
    pages = [(1, p, k, 5, x) for p in range(5) for k, x in enumerate(["页眉", f"正文{p}", f"a{p}", f"b{p}", "页脚" if p < 4 else "别的"])]
    got = cleaning.repeated_boundaries(spark.createDataFrame(pages, "doc_id int, page_no int, line_no int, n_lines int, line string"))
    assert {(r["side"], r["position"], r["line"], r["n_on"]) for r in got.collect()} == {("top", 0, "页眉", 5), ("bottom", 0, "页脚", 4)}


def test_ranking(spark):
    lists = [[("q", "a", 1), ("q", "b", 2)], [("q", "b", 1), ("q", "c", 2)]]
    fused = retrieval.rrf([spark.createDataFrame(x, "query_id string, doc_id string, rank int") for x in lists]).orderBy("rank").collect()
    assert [r["doc_id"] for r in fused] == ["b", "a", "c"] and math.isclose(fused[0]["score"], round(1 / 61 + 1 / 62, 9))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [0.6, 0.8])], "vec_id long, embedding array<float>")
    top = retrieval.dense_topk(vectors.filter("vec_id = 0"), vectors, k=10).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["similarity"], 6)) for r in top] == [(0, 1.0), (1, 1.0), (5, 0.6), (2, 0.0)]
    with pytest.raises(Exception, match="not finite"):
        retrieval.dense_topk(vectors.filter("vec_id = 0"), spark.createDataFrame([(9, [float("nan"), 1.0])], "vec_id long, embedding array<float>")).collect()
    assert retrieval.dense_topk(vectors.filter("vec_id = 99"), vectors).count() == 0


def test_bm25_matches_its_definition(spark):
    docs = {1: "tax tax law", 2: "law", 3: "court", 4: "tax"}
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(spark.createDataFrame([(7, "tax law zzz tax")], "query_id int, query string"), spark.createDataFrame(list(docs.items()), "doc_id int, text string")).collect()}
    tokens = {k: v.split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    raw = {t: math.log(n - sum(t in x for x in tokens.values()) + 0.5) - math.log(sum(t in x for x in tokens.values()) + 0.5) for t in ("tax", "law")}
    floor = 0.25 * sum(raw.values()) / 2
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    want = {d: round(sum(q * idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t, q in (("tax", 2), ("law", 1))), 6) for d, x in tokens.items() if {"tax", "law"} & set(x)}
    assert got == want
    single = retrieval.bm25_candidates(spark.createDataFrame([(1, "tax", 5, "court", 1)], "query_id int, query string, doc_id int, text string, position int")).collect()
    assert single[0]["score"] is None and single[0]["rank"] == 1


def test_routes_and_rerank(spark):
    hits = spark.createDataFrame([("a", 0.995, 1, "yes"), ("b", 0.9, 1, "no"), ("b", 0.86, 2, "n"), ("c", 0.2, 1, "z"), ("d", 0.999, 1, " ")], "query_id string, similarity double, rank int, answer string")
    assert {r["query_id"]: r["route"] for r in retrieval.faq_route(hits).collect()} == {"a": "faq_direct", "b": "faq_context", "c": "none", "d": "faq_context"}
    rows = spark.createDataFrame([("q", "tax law", 1, "court", 1), ("q", "tax law", 2, "law of tax", 2), ("q", "tax law", 3, None, 3)], "query_id string, query string, doc_id int, text string, rank int")
    assert [r["doc_id"] for r in retrieval.rerank(rows).orderBy("final_rank").collect()] == [2, 1, 3]
    parents = retrieval.recall_parents(spark.createDataFrame([("q", "p", 1), ("q", "p", 2), ("q", "r", 3), ("q", "s", 4)], "query_id string, parent_id string, rank int"), spark.createDataFrame([("p", "x"), ("r", " "), ("s", "y")], "parent_id string, content string"))
    assert [(r["parent_id"], r["parent_rank"]) for r in parents.orderBy("parent_rank").collect()] == [("p", 1), ("s", 2)]


@pytest.mark.parametrize("n, numeral", [(10, "十"), (11, "十一"), (20, "二十"), (30, "三十"), (101, "一百零一"), (110, "一百一十"), (188, "一百八十八"), (205, "二百零五"), (1001, "一千零一"), (1010, "一千零一十"), (1260, "一千二百六十"), (9999, "九千九百九十九")])
def test_numerals(n, numeral):
    assert citations.to_chinese(n) == numeral and citations.to_int(numeral) == n


def test_numerals_round_trip():
    assert all(citations.to_int(citations.to_chinese(n)) == n for n in range(1, 10_000))
    assert citations.to_int("甲") == -1 and citations.to_int("42") == 42 and citations.to_chinese(10_000) == "10000"


def test_citation_extraction():
    got = citations.extract("根据《劳动合同法》第三十八条第二款：劳动者可以解除合同。依照本法第四十条另行处理。又见《仲裁法》第三条至第五条。")
    assert [(c["law"], c["article"], c["clause"]) for c in got] == [("劳动合同法", 38, 2), ("仲裁法", 3, None), ("仲裁法", 4, None), ("仲裁法", 5, None)]
    assert got[0]["quote"].startswith("劳动者可以解除合同") and citations.extract(None) == []


@pytest.mark.parametrize(("answer", "want"), [
    ("《某法》第三条至第五条对此作了规定。", [("某法", 3, None, ""), ("某法", 4, None, ""), ("某法", 5, None, "对此作了规定")]),
    ("根据《民法典》第三十条的规定，应当履行。", [("民法典", 30, None, "")]),
    ("《某法》第三十条和第七十七条等处理", [("某法", 30, None, ""), ("某法", 77, None, "")]),
    ("《某法》：\n- 第8条: 甲依照本法第九条办理；\n总结一句。\n- 第九条第二款：乙。", [("某法", 8, None, "甲依照本法第九条办理"), ("某法", 9, 2, "乙")]),
    ("第八条 无名。《劳动法》第零条，第八条 有名……", [("", 8, None, "无名"), ("劳动法", 8, None, "有名……")]),
    ("第三十条有规定", [("", 30, None, "第三十条")]),
    ("本法第三条至第四条", [("", 4, None, "第四条")]),
    ("《某法》第一条至第九百条", [("某法", 1, None, ""), ("某法", 900, None, "")]),
])
def test_citation_tokens(answer, want):
    assert [(c["law"], c["article"], c["clause"], c["quote"]) for c in citations.extract(answer)] == want


def test_window_ratio_reads_the_whole_segment():
    text = "".join(f"承租人第{k}次应当支付租金并取得收据。" for k in range(400))
    assert len(text) > 5_000 and citations.window_ratio("出租人应当在三十日内退还押金", text + "出租人应当在三十日内退还保证金") > 0.8
    assert citations.window_ratio("", text) == citations.window_ratio("甲", "") == 0.0 and citations.window_ratio("丙丁", "甲乙") == 0.0


def test_citation_ladder(spark):
    evidence = "[Source Metadata]\ntitle: 中华人民共和国劳动合同法\n\n第三十条 用人单位应当按月支付工资，比例为百分之五十。拖欠的可以申请支付令。\n第三十一条 用人单位不得强迫加班。"
    answers = [(1, "《劳动合同法》第三十条：用人单位应当按月支付工资，比例为百分之五十。"), (2, "《劳动合同法》第三十条：用人单位应当按月支付工资，比例为百分之六十。"), (3, "《劳动合同法》第九十条：无。"), (4, "《仲裁法》第三条：无。"), (5, "《劳动合同法》第三十一条：用人单位不得强迫员工加班。"), (6, "《劳动合同法》第三十条")]
    rows = spark.createDataFrame([(i, a, [evidence, None]) for i, a in answers] + [(7, "《仲裁法》第三条", None)], "answer_id int, answer string, evidence array<string>")
    assert {r["answer_id"]: r["status"] for r in citations.verify_citations(rows).collect()} == {1: "grounded", 2: "text_mismatch", 3: "article_missing", 4: "law_not_in_evidence", 5: "grounded", 6: "grounded"}
    assert not citations.same_law("劳动争议调解仲裁法", "仲裁法") and citations.same_law("劳动合同法", "中华人民共和国劳动合同法")


def test_metadata(spark):
    lines = ["发 文 机 关：国务院", "成文日期：2024年13月1日", "发布日期", "2024年3月5日", "无关：值", "文号：国发 1号", "文号：国发 2号"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id int, line_no int, line string")
    got = {r["field"]: (r["status"], r["value"]) for r in metadata.resolve(metadata.candidates_from_lines(rows)).collect()}
    assert got == {"source_org": ("RESOLVED", "国务院"), "creation_date": ("NORMALIZATION_FAILED", None), "publish_date": ("RESOLVED", "2024-03-05"), "document_number": ("CONFLICT", None)}
    tiers = spark.createDataFrame([(1, "title", "a", 50), (1, "title", "b", 30)], "doc_id int, field string, raw_value string, tier int")
    assert metadata.resolve(tiers).first()["value"] == "a"


def test_contract_invariants(spark):
    sha = "a" * 64
    schema = "chunk_id string, document_id string, source_file string, source_sha256 string, source_format string, chunk_index long, block_orders array<int>, order_start int, order_end int, page_start int, page_end int, pages array<int>, chapter string, section string, article string, contains_table boolean, table_orders array<int>, parent_chunk_id string, chunk_level string, extras map<string,string>, title string"
    base = dict(chunk_id="0" * 32, document_id="d", source_file="f", source_sha256=sha, source_format="md", chunk_index=0, block_orders=[1, 2], order_start=1, order_end=2, page_start=1, page_end=2, pages=[1, 2], chapter="第一章", section=None, article=None, contains_table=False, table_orders=None, parent_chunk_id=None, chunk_level=None, extras=None, title="t")
    breakers = {
        "INV1": {"chunk_id": "X" * 32}, "INV2": {"document_id": ""}, "INV3": {"source_sha256": "zz"}, "INV4": {"block_orders": []}, "INV5": {"block_orders": [2, 1]}, "INV6": {"block_orders": [1, 1, 2]}, "INV7": {"order_end": 9}, "INV8": {"page_start": 3},
        "INV9": {"pages": [7]}, "INV10": {"article": " "}, "INV11": {"section": "x__UNSET__"}, "INV12": {"extras": {"k": "v"}}, "INV13": {"contains_table": True, "table_orders": [9]}, "INV14": {"parent_chunk_id": "p", "chunk_level": "other"}, "INV15": {"title": "n/a"}, "INV17": {},
    }
    names = [x.split()[0] for x in schema.split(", ")]
    got = contract.violations(spark.createDataFrame([tuple((base | b)[n] for n in names) for b in breakers.values()], schema)).collect()
    for name, row in zip(breakers, got):
        assert name in row["violations"], (name, row["violations"])
    good = base | {"chunk_id": one(spark, text.chunk_id(F.lit(sha), F.lit("d"), F.lit(0), F.lit(1), F.lit(2)))}
    assert contract.violations(spark.createDataFrame([tuple(good[n] for n in names)], schema)).first()["violations"] == []
    assert contract.projection_table(spark).count() == 18


def test_state(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, k, t0 + dt.timedelta(seconds=s)) for k, s in enumerate([0, 0, 10, 70, 71])] + [(2, 9, t0)], "user_id int, event_id int, ts timestamp_ntz")
    got = {r["event_id"]: (r["n_in_window"], r["allowed"], r["retry_after"]) for r in state.rate_limit(rows, "user_id", "ts", "event_id", limit=2).collect()}
    assert got == {0: (2, True, None), 1: (2, True, None), 2: (3, False, 50), 3: (2, True, None), 4: (2, True, None), 9: (1, True, None)}
    assert [r["event_id"] for r in state.last_turns(rows, "user_id", ["ts", "event_id"], 2).filter("user_id = 1").orderBy("line_no").collect()] == [3, 4]
    assert state.prune(rows, "user_id", ["ts", "event_id"], 4).count() == 1
    assert {r["event_id"] for r in state.evict(rows, ["user_id"], "ts", "event_id", 3).collect()} == {0, 1}


def test_ingest(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string"), spark.createDataFrame([(2, "d")], "k int, v string")
    assert sorted(map(tuple, ingest.replace_rows(old, new, "k").collect())) == [(1, "a"), (2, "d")] == sorted(map(tuple, ingest.replace_rows(ingest.replace_rows(old, new, "k"), new, "k").collect()))
    assert ingest.multiset_difference(old, old).count() == 0 and {r["surplus"] for r in ingest.multiset_difference(old, new).collect()} == {1, -1}
    assert {(r["k"], r["side"]) for r in ingest.reconcile(old, new, "k").collect()} == {(1, "left_only")}
    assert ingest.fingerprint(old, "v").first() == ingest.fingerprint(old.union(old), "v").first() != ingest.fingerprint(new, "v").first()
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "4")], "logical_document_id string, normalized_sha256 string")
    incoming = spark.createDataFrame([("a", "1", "f"), ("b", "9", "f"), ("c", "3", "f"), ("d", "5", "f"), ("e", "6", "f"), ("e", "6", "g")], "logical_document_id string, normalized_sha256 string, source_file string")
    assert {r["logical_document_id"]: r["action"] for r in ingest.select_documents(manifest, incoming).collect()} == {"a": "unchanged", "b": "needs_replace_flag", "c": "conflict_in_manifest", "d": "new", "e": "duplicate_in_batch"}
    found, bad = ingest.fetch_parents(spark.createDataFrame([("p", 1), ("q", 2), ("p", 3)], "external_parent_id string, position int"), spark.createDataFrame([("p", "x" * 9000)], "external_parent_id string, content string"))
    assert {(r["external_parent_id"], r["violation"]) for r in bad.collect()} == {("p", "too_long"), ("q", "missing")} and found.count() == 1


def test_evaluation(spark):
    rows = [("A", 1, 2, True, False), ("A", 1, 1, False, False), ("B", 1, 1, True, True), ("A", 2, 1, False, False), ("B", 2, 1, False, False)]
    results = spark.createDataFrame([(s, "t", "hard", q, r, h, c) for s, q, r, h, c in rows], "strategy string, query_type string, difficulty string, query_id int, rank int, hit boolean, cite_hit boolean")
    m = {(r["strategy"], r["query_type"]): (r["hit_rate"], r["mrr"]) for r in evaluation.metrics(results).collect()}
    assert m == {("A", "ALL"): (0.5, 0.25), ("A", "t"): (0.5, 0.25), ("B", "ALL"): (0.5, 0.5), ("B", "t"): (0.5, 0.5)}
    pairs = evaluation.paired(results, "A", "B")
    assert [(r["bucket"], r["query_id"]) for r in evaluation.failure_samples(pairs).collect()] == [("both_miss", 2)]
    interval = evaluation.bootstrap_interval(pairs, evaluation.draws_table(spark, 2, 200)).first()
    assert interval["resamples"] == 200 and 0 <= interval["d_mrr_low"] <= interval["d_mrr_high"] <= 0.5
    assert evaluation.release_gate(evaluation.metrics(results), "A", "B").first()["gate"] == "PASS"


PAGE = """<html><head><title>河道条例 - 某法务网</title><meta name="pubdate" content="2024-01-01"></head><body><nav>首页 <a href="/">公告</a></nav>
<div class="main"><h1>河道条例</h1><p>第一条 为了保护河道，制定本条例。</p><p>第二条 适用于全市<b>河道</b><ul><li>一项<ul><li>子项</li></ul></li><li>二项</li></ul>散落文字
<table><tr><th>项</th><th>值</th></tr><tr><td colspan=2>合计</td></tr></table><p>本条例自公布之日起施行。本条例由市水务局负责解释，过去的规定与本条例不一致的，以本条例为准，有关部门应当及时修订。</p></div>
<div class="pagination"><a href="?page=1">1</a><a href="?page=2">2</a><a href="?page=3">下一页</a></div><script>x()</script><footer>版权所有</footer></body></html>"""


def test_html_blocks(spark):
    meta, got = html.blocks(PAGE)
    assert meta == {"publish_date": "2024-01-01", "title": "河道条例"}
    assert [(t, x) for t, x, _, _ in got][:7] == [("HEADING", "河道条例"), ("PARAGRAPH", "第一条 为了保护河道，制定本条例。"), ("PARAGRAPH", "第二条 适用于全市河道"), ("LIST_ITEM", "一项"), ("LIST_ITEM", "子项"), ("LIST_ITEM", "二项"), ("UNKNOWN", "散落文字")]
    assert got[7][3] == [["项", "值"], ["合计", ""]] and not any("版权" in x or "下一页" in x for _, x, _, _ in got)
    assert html.html_blocks(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).count() == len(got)


def test_similarity_quantiles_see_all_rows(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    pairs = [round(float(unit[q] @ unit[c]), 9) for q in range(0, 300, 50) for c in range(300) if q != c and (c % 50 or q < c)]
    for block in (2_000, 2):
        got = retrieval.similarity_quantiles(rows.filter("vec_id % 50 = 0"), rows, block=block).first()
        assert got["n_pairs"] == len(pairs) == 6 * 294 + 15
        for name, share in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99), ("p100", 100)):
            assert got[name] == pytest.approx(float(np.percentile(pairs, share)), abs=2e-6)
        assert got["threshold"] == pytest.approx(min(max(pairs) + 0.03, 0.97), abs=2e-6)
    assert retrieval.similarity_quantiles(rows.limit(0), rows).first()["n_pairs"] == 0


def test_citation_verify_counts_articles_without_a_law(spark, tmp_path):
    from lexweave.plans import ingest as plans

    rows = [("a", "《税法》第一条规定纳税。"), ("b", "槙葛法第39条の規定による。"), ("c", "第2条"), ("d", "no article"), ("e", None)]
    spark.createDataFrame(rows, "external_parent_id string, content string").write.parquet(str(tmp_path / "legal_parent_contract_v1.parquet"))
    got = plans.citation_verify(spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in got) == 3


def test_semantic_cache_sees_other_queries(spark, tmp_path):
    from lexweave.plans import state as plans

    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (50, [1.0, 0.1]), (100, [0.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["query_id"]: (r["vec_id"], r["cache_hit"]) for r in plans.semantic_cache_lookup(spark, str(tmp_path)).collect()}
    assert got == {0: (50, True), 50: (0, True), 100: (0, False)}


def test_identity_fingerprint_tells_sets_of_equal_size_apart(spark, tmp_path):
    from lexweave.plans import ingest as plans

    def of(name, values):
        spark.createDataFrame([(v,) for v in values], "document_identity string").write.parquet(str(tmp_path / name / "legal_parent_contract_v1.parquet"))
        return plans.identity_fingerprint(spark, str(tmp_path / name)).first()

    a, b, c = of("a", ["x", "y", "y", None]), of("b", ["y", "x"]), of("c", ["x", "z"])
    assert a == b and a["n"] == c["n"] == 2 and a["fingerprint"] != c["fingerprint"]


def test_numeral_table_is_whole(spark, tmp_path):
    from lexweave.plans import ingest as plans

    rows = plans.cn_numeral_table(spark, str(tmp_path)).collect()
    assert [r["n"] for r in rows] == list(range(1, 10_000)) and all(citations.to_int(r["numeral"]) == r["n"] for r in rows)
    assert rows[9998]["numeral"] == "九千九百九十九" and rows[1009]["numeral"] == "一千零一十"

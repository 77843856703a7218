import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexweave.operators import records
from lexweave.session import spread

T0 = dt.datetime(2024, 1, 1)


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_projection_keeps_order_and_leaves_atomic_children(spark):
    schema = "doc string, path string, child_id string, content string, atomic boolean, n_children int"
    data = [("d", "a", "2", "two", None, 9), ("d", "a", "1", "one", False, 9), ("d", "a", "1", "one", False, 9), ("d", "a", "3", "t", True, 9), ("d", "b", "4", "alone", False, 9), (None, None, "5", "x", None, None), (None, None, "6", "y", None, None), ("d", "b", "7", None, None, None)]
    got = records.parent_projection(spark.createDataFrame(data, schema), ["doc", "path"], "child_id")
    assert rows(got, "doc", "path", "n_children", "content") == sorted([("d", "a", 2, "one\n\ntwo"), (None, None, 2, "x\n\ny")], key=str)
    assert records.parent_projection(spark.createDataFrame([], schema), ["doc"], "child_id").count() == 0


def test_gold_gate_counts_documents_and_phrases(spark):
    hits = spark.createDataFrame([(1, 1, "LAW_1@x", "the fee  is due"), (1, 6, "LAW_2@x", "z"), (2, 1, "LAW_10@x", "other"), (3, 1, None, None)], "query_id int, rank int, document_identity string, text string")
    gold = spark.createDataFrame([(1, "LAW_1", "fee is"), (2, "LAW_1", "none"), (3, "LAW_3", "a"), (4, "LAW_4", None)], "query_id int, target_doc string, phrase string")
    r = records.gold_gate(hits, gold).first()
    assert (r["n"], r["n_document"], r["n_phrase"], r["n_passed"], r["gate"]) == (4, 1, 1, 1, "FAIL")
    assert records.gold_gate(hits, gold.limit(1)).first()["gate"] == "PASS"


def test_separator_goes_only_right_after_junk(spark):
    data = [(1, 0, True, False), (1, 1, False, True), (1, 2, False, True), (1, 3, False, False), (2, 0, False, True)]
    got = records.drop_separators_after_junk(spark.createDataFrame(data, "d int, n int, junk boolean, separator boolean"), ["d"], "n")
    assert rows(got, "d", "n") == [(1, 2), (1, 3), (2, 0)]


def test_codec_slices_and_flags(spark):
    vectors = spark.createDataFrame([(1, [0.5, -2.0]), (2, None), (3, [])], "k int, v array<float>")
    got = {r["k"]: r for r in records.vector_codec(vectors, "k", "v").collect()}
    assert got[1]["encoded"] == "AAAAPwAAAMA=" and got[1]["decoded"] == [0.5, -2.0] and got[2]["decoded"] is None and got[3]["decoded"] == []
    texts = spark.createDataFrame([("x" * 85,), ("",), (None,), ("条" * 40,)], "t string").select(records.text_slices("t").alias("s")).collect()
    assert [[len(x) for x in r["s"]] for r in texts] == [[40, 40, 5], [], [], [40]]
    flags = spark.createDataFrame([('{"qg_a": "1", "qgate": "2", "title": "3"}',), (None,)], "m string").select(records.quality_flags("m").alias("f")).collect()
    assert flags[0]["f"] == {"qg_a": "1", "qgate": "2"} and flags[1]["f"] is None


def test_lookups_keep_unmatched_rows(spark):
    hits = spark.createDataFrame([("a", "text"), ("b", "bare"), (None, "none")], "k string, text string")
    manifest = spark.createDataFrame([("a", "head"), ("a", "head"), (None, "null")], "k string, header string")
    assert rows(records.with_source_header(hits, manifest, "k"), "k", "text") == sorted([("a", "head\n\ntext"), ("b", "bare"), (None, "none")], key=str)
    users = records.resolve_users(spark.createDataFrame([(1,), (1,), (2,)], "visitor_id long"), spark.createDataFrame([(1, 7), (1, 9)], "visitor_id long, user_id long"))
    assert rows(users, "visitor_id", "user_id", "anonymous") == [(1, 9, False), (2, 2, True)]
    mapping = spark.createDataFrame([("c", "p"), ("c", "p"), ("d", None), ("e", "gone")], "child_id string, external_parent_id string")
    parents = spark.createDataFrame([("p", "old", T0), ("p", "new", T0 + dt.timedelta(1))], "external_parent_id string, content string, created_at timestamp_ntz")
    assert rows(records.mapped_parents(mapping, parents), "child_id", "content") == [("c", "new")]


def test_counts_and_dictionaries(spark):
    docs = spark.createDataFrame([(k, "s" if k < 20 else None) for k in range(25)], "k int, s string")
    r = records.value_dictionary(docs, "s", "k").collect()
    assert [(x["s"], x["n"], x["examples"]) for x in r] == [("s", 20, "0,1,2,3,4,5,6,7")]
    assert rows(records.frequent_values(docs, "s", 20), "s", "n") == [("s", 20)] and records.frequent_values(docs, "s", 21).count() == 0
    got = records.against_expected(docs.agg(F.count("*").alias("n")), {"n": 25})
    assert rows(got, "name", "actual", "ok") == [("n", 25, True)]
    chunks = spark.createDataFrame([("a", "x", "HEADING", 1), ("a", "第一条", None, 1), ("a", "y" * 40, None, 1), ("a", "z", "LIST", 2)], "s string, content string, kind string, n_articles int")
    assert rows(records.orphan_counts(chunks, ["s"]), "chunks", "heading_only", "article_orphans") == [(4, 1, 1)]
    cover = records.block_coverage(spark.createDataFrame([("d", [0, 1, 1, 9])], "document_identity string, block_orders array<int>"), spark.createDataFrame([("d", k) for k in range(4)] + [("e", 0)], "document_identity string, block_order int"))
    assert rows(cover, "document_identity", "coverage_pct") == [("d", 50.0), ("e", 0.0)]


@pytest.mark.parametrize("most", [0, 10**12])
def test_spread_deals_out_small_tables_only(spark, most):
    small = spark.range(10).coalesce(1)
    assert spread(small, most).rdd.getNumPartitions() == (1 if most == 0 else spark.sparkContext.defaultParallelism)

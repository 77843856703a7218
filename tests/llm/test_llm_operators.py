import datetime as dt
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import boilerplate, codes, hyperminhash, leakage, lookalikes, neardup, packing, repeated_lines, sentences, splitting, tokens

T0 = dt.datetime(2024, 1, 1)
WORDS = "承租人 出租人 许可 期限 施工 图纸 登记 机关 合同 解除 费用 比例 负担 通知 利害 关系 审查 期间 公告 文书".split()


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice(["", "，", "。"]) for _ in range(n))


# --- shared code-point helpers -------------------------------------------------------------------------------------


def test_code_points_and_folding_equal_python():
    rng = random.Random(1)
    texts = [None, "", "Straße ﬁn Ｃａfé é İ 𝒳 第１条、한국 ｶﾞ", "a" * 5000, *("".join(rng.choice("aＢß́é中、 𐐀ﬁ１\n") for _ in range(rng.randrange(60))) for _ in range(80))]
    column = pa.array(texts, pa.string())
    for sliced in (column, column.slice(2, 30)):
        raw, starts = codes.code_points(sliced)
        folded, ends = codes.folded(sliced)
        for k, t in enumerate(sliced.to_pylist()):
            assert codes.text_of(raw[starts[k] : starts[k + 1]]) == (t or "")
            assert codes.text_of(folded[ends[k] : ends[k + 1]]) == codes.fold_text(t or "")
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    assert sum(b.num_rows for b in codes.slices(batch, "text", 100)) == len(texts)


# --- 2 page boilerplate --------------------------------------------------------------------------------------------

PAGE = "page_id long, candidate_no int, site string, text string, link_density double, fetched_at timestamp_ntz, share double, line_key int"


def test_boilerplate_finds_the_article_and_survives_dirt(spark):
    nav, footer = "首页 公告 下载 登录 注册 检索", "© 某某法务网 版权所有 备案号 12-3 联系我们 友情链接 网站地图"
    body = "第一条 承租人应当按照约定的期限支付租金，出租人应当出具收据。第二条 当施工图纸出现毁损时，登记机关应当在30个工作日内通知利害关系人。"
    rows = [(1, 0, "s", nav, 0.9, T0, 1.0, 1), (1, 1, "s", "河道通行细则", 0.1, T0, 1.0, 1), (1, 2, "s", body, 0.05, T0, 1.0, 1), (1, 2, "s", body, 0.05, T0, 1.0, 1), (1, 3, "s", footer, None, T0, 1.0, 1)]
    rows += [(2, 0, None, nav, None, None, None, None), (2, 1, "s", None, None, T0, None, None), (2, 2, "s", "", 0.0, T0, None, None), (3, 0, "s", body * 3000, 0.0, T0, None, None), (None, 0, "s", body, 0.1, T0, None, None), (4, None, "s", body, 0.1, T0, None, None)]
    got = {(r["page_id"], r["candidate_no"]) for r in boilerplate.main_blocks(spark.createDataFrame(rows, PAGE)).collect()}
    assert (1, 2) in got and (1, 0) not in got and (1, 3) not in got and not {p for p, _ in got} - {1, 3}
    assert boilerplate.main_blocks(spark.createDataFrame([], PAGE)).count() == 0


def test_boilerplate_tree_on_held_out_pages(spark):
    import json
    from pathlib import Path

    held = [json.loads(line) for line in Path(__file__).with_name("held_out_blocks.jsonl").read_text(encoding="utf-8").splitlines()]
    known = {json.loads(line)["text"] for line in boilerplate.LABELLED.read_text(encoding="utf-8").splitlines()}
    assert len(held) > 300 and not [r for r in held if r["main"] and r["text"] in known]
    wording, tree = boilerplate.model()
    used = tree.splits()
    assert {"link_density", "words"} <= set(used) and set(used) & {"prev_words", "next_words", "prev_density", "next_density"} and used.count("wording") <= len(used) / 2
    texts = boilerplate.Texts.of(pa.array([r["text"] for r in held], pa.string()))
    words, density, _ = texts.form()
    rows = [(r["page"], r["no"], float(w), float(d), float(r["site_share"]), float(o), r["main"]) for r, w, d, o in zip(held, words, density, wording.score(texts))]
    features = boilerplate.with_neighbours(spark.createDataFrame(rows, "page_id long, candidate_no int, words double, link_density double, site_share double, wording double, main boolean"))
    got = features.select("main", ((boilerplate.as_column(tree) > 0.5) & (F.col("words") > 0)).alias("said")).collect()
    both, true, said = sum(r["main"] and r["said"] for r in got), sum(r["main"] for r in got), sum(r["said"] for r in got)
    assert both / true >= 0.9 and both / said >= 0.9


def test_block_features_are_read_off_the_text():
    lines = ["Home Contact Search", "A > B > C", "The lessee pays 5 marks.\nRead more", "条款规定如下。", "推荐：合同到期后……", "box 12.50 AB-12", "", None, "Ends here.”  ", "Wait...\n\n \nx|y", "…"]
    got = [tuple(np.round(x, 3)) for x in zip(*boilerplate.Texts.of(pa.array(lines, pa.string())).form())]
    assert got == [(3, 1, 1), (3, 1, 3), (7, 0.286, 1), (3, 0, 0), (3.5, 1, 2), (5, 0, 0), (0, 0, 0), (0, 0, 0), (2, 0, 0), (3, 1, 4), (0, 0, 2)]
    empty = boilerplate.Texts.of(pa.array([], pa.string()))
    assert len(empty.form()[0]) == len(empty.line_keys()) == 0
    same = boilerplate.Texts.of(pa.array(["Page 12, of 345!", "ＰＡＧＥ 7 of 9", "page of", "", None, "Page12of1"], pa.string())).line_keys()
    assert same[0] == same[1] == same[5] != same[2] and same[3] == same[4] == 0


def test_tree_and_its_expression_agree(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(boilerplate.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    tree = boilerplate.grow(x, y, depth=4, leaf=3)
    got = [r[0] for r in spark.createDataFrame([tuple(map(float, r)) for r in x], list(boilerplate.FEATURES)).select(boilerplate.as_column(tree)).collect()]
    assert np.mean((np.array(got) > 0.5) == (y > 0.5)) > 0.97


# --- 3 near duplicates ---------------------------------------------------------------------------------------------

RECORD = "record_id string, text string, a string, n int, digest string"


def jaccard(a, b):
    x, y = neardup.shingles(a), neardup.shingles(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = random.Random(5), {}
    for g in range(12):
        base = prose(rng, 60)
        for k in range(rng.randrange(1, 5)):
            cut = list(base)
            for _ in range(rng.randrange(0, 12)):
                cut.insert(rng.randrange(len(cut)), rng.choice(WORDS))
            texts[f"r{g}-{k}"] = "".join(cut)
    texts |= {"copy1": texts["r0-0"], "copy2": texts["r0-0"], "short": "abc", "short2": "abc", "empty": "", "long": "x" * 20 + prose(rng, 30_000)}
    rows = [(i, t, "a", 1, "d") for i, t in texts.items()] + [("r0-0", texts["r0-0"], "a", 1, "d"), (None, "x" * 50, None, None, None), ("null", None, None, None, None)]
    want = {(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.7}
    assert len(want) > 8
    got = {tuple(r) for r in neardup.alike_pairs(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == want
    classes = neardup.duplicate_classes(spark.createDataFrame(rows, RECORD)).collect()
    group = {r["record_id"]: r["class_id"] for r in classes}
    assert group.keys() == texts.keys() and all(group[a] == group[b] for a, b in want) and len(classes) == len(texts)
    assert neardup.alike_pairs(spark.createDataFrame([], RECORD)).count() == 0


def test_hot_buckets_are_cut_into_blocks(spark):
    rows = spark.range(60).select(F.lit("k").alias("key"), F.format_string("%03d", "id").alias("id"))
    got = [tuple(r) for r in neardup.pairs_within(rows, ["key"], "id", [], block=7).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2 and all(a < b for a, b in got)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a int, b int")
    got = {r["node"]: r["label"] for r in neardup.components(edges).collect()}
    assert {got[k] for k in range(41)} == {0} and got[101] == 100


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for shared, own in ((800, 100), (500, 250), (60, 10), (0, 400)):
        pool = rng.integers(0, 1 << 62, shared + 2 * own, dtype=np.uint64)
        a, b = pool[: shared + own], np.concatenate([pool[:shared], pool[shared + own :]])
        s = hyperminhash.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        got = hyperminhash.similarity(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0]
        errors.append(abs(got - shared / (shared + 2 * own)))
    assert max(errors) < neardup.MARGIN


# --- 4 splitting ---------------------------------------------------------------------------------------------------

ITEM = "item_kind string, item_id string, content string, text string, n_pieces int"
LIMIT = "item_kind string, size_unit string, max_size int, overlap_size int"


@pytest.mark.parametrize("seed", range(4))
def test_cuts_cover_with_the_overlap(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice("ab c.。，\n é𝒳國") for _ in range(rng.randrange(700)))
        limit, overlap = rng.choice([1, 2, 7, 40, 200]), rng.choice([0, 1, 5, 39, 300])
        pieces, step = splitting.cut(text, limit, overlap), min(overlap, limit - 1)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= limit for a, b, _ in pieces)
        assert all(b - c == step and d > b for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]))
        rebuilt = text[pieces[0][0] : pieces[0][1]] + "".join(text[b:d] for (_, b, _), (_, d, _) in zip(pieces, pieces[1:]))
        assert rebuilt == text


def test_splitting_prefers_natural_boundaries_and_survives_dirt(spark):
    text = "第一句。" * 30 + "\n\n" + "长" * 300
    assert splitting.cut(text, 130, 10)[0][2] == "paragraph" and splitting.cut("长" * 300, 100, 10)[0][2] == "hard"
    token_pieces = splitting.cut("word 中文 " * 80, 50, 5, splitting.TOKENS)
    assert len(token_pieces) > 2 and all(len(tokens.encoding().encode_ordinary(("word 中文 " * 80)[a:b])) <= 52 for a, b, _ in token_pieces)
    rows = [("parent", "p", "x" * 50, "q", 1), ("parent", "p", "x" * 50, "q", 1), ("parent", "ok", "y" * 10, None, None), ("child", "c", "z" * 9, None, None), ("other", "o", "x" * 999, None, None), ("parent", None, "v" * 40, None, None), (None, "n", "w", None, None), ("parent", "nil", None, None, None), ("parent", "e", "", None, None), ("parent", "big", "大" * 200_000, None, None)]
    limits = spark.createDataFrame([("parent", "characters", 20, 5), ("child", "tokens", 3, 0)], LIMIT)
    got = splitting.distinct_pieces(splitting.split_items(spark.createDataFrame(rows, ITEM), limits))
    assert {tuple(r) for r in splitting.oversized(got).collect()} == {("parent", "p"), ("parent", None), ("parent", "big"), ("child", "c")} - ({("child", "c")} if len(tokens.encoding().encode_ordinary("z" * 9)) <= 3 else set())
    assert got.filter("item_id = 'p'").count() == 3 and got.filter("item_id in ('nil')").count() == 0 and got.filter("item_id = 'e'").count() == 1
    assert splitting.split_items(spark.createDataFrame([], ITEM), limits).count() == 0 and splitting.split_items(spark.createDataFrame(rows, ITEM), spark.createDataFrame([], LIMIT)).filter("n_pieces > 1").count() == 0


# --- 5 look-alikes -------------------------------------------------------------------------------------------------


def test_fold_and_respell():
    assert lookalikes.fold("x​y ﬁle Ｃａｆé 　，！～ Ⅳ ② m² ⼀ 料 ok") == ("xy file Café 　，！～ IV ② m² 一 料 ok", ["compatibility", "invisible", "marks", "space", "width"])
    assert lookalikes.fold("क‍ष Café Übung “引文”……（一）") == ("क‍ष Café Übung “引文”……（一）", [])
    assert lookalikes.respell("Оffіce") == "Office" and lookalikes.respell("Филиaл") == "Филиал" and lookalikes.respell("Δt") is None and lookalikes.respell("Филиал") is None and lookalikes.respell("office") is None


def test_consistent_texts(spark):
    schema = "item_kind string, item_id string, text string, digest string, w int"
    rows = [("parent", "a", "The оffice is open", None, 1), ("parent", "a", "The оffice is open", None, 1), ("parent", "b", "The office is open", None, 1), ("parent", "c", "rаrewordxyz", None, 1), ("parent", "d", None, None, 1), ("parent", "e", "", None, 1), (None, None, "full １２", None, 1), ("parent", "f", "长" * 100_000 + "​", None, 1)]
    items = spark.createDataFrame(rows, schema)
    got = {r["item_id"]: r for r in lookalikes.consistent_texts(items, items.select("text")).filter("item_id <> 'b' or item_id is null").collect()}
    assert got["a"]["consistent"] == "The office is open" and (got["a"]["n_mixed"], got["a"]["n_respelt"]) == (1, 1)
    assert got["c"]["consistent"] == "rаrewordxyz" and (got["c"]["n_mixed"], got["c"]["n_respelt"]) == (1, 0)
    assert got[None]["consistent"] == "full 12" and got["e"]["consistent"] == "" and "d" not in got and len(got["f"]["consistent"]) == 100_000
    assert lookalikes.consistent_texts(spark.createDataFrame([], schema), items.select("text")).count() == 0


# --- 6 repeated lines ----------------------------------------------------------------------------------------------

BLOCK = "document_identity string, source_site string, original_block_order int, text_preview string, decided_at timestamp_ntz, line string, h1 int"
GROUP = "document_identity string, block_orders array<int>, normalized_text string, source_site string"


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(9)
    rows, groups = [], []
    for d in range(40):
        site = "hot" if d < 25 else None if d % 3 == 0 else "s"
        for k in range(6):
            text = rng.choice(["分享到：微信", "分 享到: 微信", "第12页 共 30页", "Share This!", "ＳＨＡＲＥ this", f"正文{prose(rng, 3)}", "----"])
            if rng.random() < 0.2:
                groups.append((f"d{d}", [k, 99], text, site))
                text = None
            rows += [(f"d{d}", site, k, text, T0, None, None)] * rng.choice([1, 1, 2])
    rows += [(None, "s", 1, "分享到：微信", T0, None, None), ("d0", "hot", 50, None, None, None, None)]
    groups.append(("d1", None, None, None))

    def key(t):
        import re
        import unicodedata

        return re.sub(r"\d+", "0", "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum()))

    listed = {(d, o): t for d, orders, t, _ in groups for o in orders or ()}
    lines = {(s, d, k, key(t if t is not None else listed[d, k])) for d, s, k, t, *_ in rows if d and (t is not None or (d, k) in listed)}
    docs, holders = defaultdict(set), defaultdict(set)
    for d, s, *_ in rows:
        if d:
            docs[s].add(d)
    for s, d, _, x in lines:
        holders[s, x].add(d)
    want = {(d, k) for s, d, k, x in lines if x and len(holders[s, x]) >= 3 and 5 * len(holders[s, x]) >= len(docs[s])}
    b, g = spark.createDataFrame(rows, BLOCK), spark.createDataFrame(groups, GROUP)
    assert {tuple(r) for r in repeated_lines.repeated_blocks(b, g, salts=3).collect()} == want and len(want) > 50
    cleaned = {r["document_identity"]: r for r in repeated_lines.cleaned_documents(b, g).collect()}
    assert sum(r["n_removed"] for r in cleaned.values()) == len(want) and cleaned.keys() == {f"d{k}" for k in range(40)}
    empty = spark.createDataFrame([], BLOCK), spark.createDataFrame([], GROUP)
    assert repeated_lines.repeated_blocks(*empty).count() == 0 and repeated_lines.cleaned_documents(*empty).count() == 0


# --- 7 packing -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_valid_and_tight(spark, seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 100])
    sizes = [(k, rng.choice([0, None, capacity, 3 * capacity + 5]) if rng.random() < 0.05 else max(1, int(rng.expovariate(5 / capacity))), "x") for k in range(rng.choice([1, 40, 600]))]
    sizes += [(0, sizes[0][1], "x"), (None, 7, "x")]
    got = packing.pack_sizes(spark.createDataFrame(sizes, "doc_id long, n_tokens long, tier string"), capacity, per_step=4).collect()
    load, step = Counter(), {}
    for r in got:
        load[r["container_id"]] += r["n_tokens"]
        step[r["container_id"]] = r["step_group"]
    total = sum(n or 0 for _, n, _ in sizes)
    assert max(load.values()) <= capacity and sum(load.values()) == total
    assert len([c for c in load if load[c]]) <= max(1, int(1.06 * -(-total // capacity)) + 1)
    pieces = Counter(r["doc_id"] for r in got)
    assert all(pieces[k] == max(1, -(-(n or 0) // capacity)) for k, n, _ in sizes if k not in (0, None))
    assert max(Counter(step.values()).values()) <= 4


@pytest.mark.parametrize("tiers", [1, 3, 4])
def test_packing_tiers_have_windows_of_their_own(spark, tiers):
    rng = random.Random(9)
    capacity = 64
    counts = Counter(min(capacity, max(1, int(rng.expovariate(6 / capacity)))) for _ in range(5000))
    packing_of = packing.Packing.of(counts, capacity, tiers)
    assert [t.window for t in packing_of.tiers] == [capacity >> t for t in range(tiers)] and all(t.windows for t in packing_of.tiers)
    rows = [(k, s) for k, s in enumerate(counts.elements())]
    got = packing.pack_sizes(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacity, 4, tiers).collect()
    windows, held, shortest = Counter(), defaultdict(set), {}
    for r in got:
        windows[r["window_id"], r["tier"]] += r["n_tokens"]
        held[r["container_id"]].add((r["window_id"], r["tier"]))
        shortest[r["doc_id"]] = r["tier"]
    assert len(windows) == len({w for w, _ in windows}) == sum(t.windows for t in packing_of.tiers)
    assert all(load <= tier for (_, tier), load in windows.items())
    assert all(len({t for _, t in ws}) == 1 and len(ws) * next(iter(ws))[1] <= capacity for ws in held.values())
    # every long window whose room would hold an item of a shorter tier has been filled before that tier opened its own
    smallest_own = {t: min((s for s, places in packing_of.places.items() if any(p[1] == t for p in places)), default=capacity) for t in range(tiers)}
    for t in range(tiers - 1):
        assert max(packing_of.tiers[t].open_gaps) < min(smallest_own[u] for u in range(t + 1, tiers))
    steps, members = Counter(), defaultdict(set)
    for r in got:
        steps[r["step_group"]] += r["n_tokens"]
        members[r["step_group"]].add(r["container_id"])
    means = [steps[k] / len(members[k]) for k in steps]
    assert max(means) <= 1.1 * min(means) and max(map(len, members.values())) - min(map(len, members.values())) <= 1


def test_packing_checks_find_faults(spark):
    docs = spark.createDataFrame([(k, "x") for k in range(6)], "doc_id long, text string")
    packed = packing.pack_sizes(spark.createDataFrame([(k, 10 * k + 1) for k in range(6)], "doc_id long, n_tokens long"), 32)
    fine = {r["check_name"]: r["n"] for r in packing.packing_checks(packed, docs, 32, unused=1.0, spread=9.0).collect()}
    assert fine.pop("documents") == 6 and set(fine.values()) == {0}
    one = packed.withColumn("container_id", F.lit(0).cast("long")).withColumn("window_id", F.lit(0).cast("long")).filter("doc_id < 5")
    bad = {r["check_name"]: r["n"] for r in packing.packing_checks(one, docs, 32).collect()}
    assert bad["containers_over"] == bad["windows_over"] == bad["lost_documents"] == 1


def test_packing_of_documents(spark):
    rows = [(1, "abc " * 400, 3), (2, None, None), (3, "", 1), (4, "条" * 100_000, 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), 256)
    sums = {r["doc_id"]: r["s"] for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("s")).collect()}
    assert sums == {k: len(tokens.encoding().encode_ordinary(t or "")) for k, t, _ in rows}
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), 256).count() == 0
    assert packing.packing_summary(got, 256).agg(F.max("max_load")).first()[0] <= 256


# --- 8 leakage -----------------------------------------------------------------------------------------------------

DOC, EVAL = "doc_id long, text string, passage string, lang string", "item_id long, passage string, lang string, text string"


def test_leakage_equals_brute_force(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, 60), "zh", "t") for k in range(8)] + [(8, " ".join(rng.choice(["permit", "court", "holder", "notice", "Straße"]) + str(rng.randrange(900)) for _ in range(60)), "EN-gb", None), (9, None, "zh", None), (10, "短", "zh", None), (8, None, None, None)]
    docs = []
    for k in range(60):
        text = prose(rng, 20)
        for _ in range(rng.randrange(3)):
            p = rng.choice(items[:9])[1]
            a = rng.randrange(len(p))
            text += p[a : a + rng.randrange(len(p))].replace("，", rng.choice(["， ", "\n", "，"]))
        docs.append((k, text.upper() if k % 7 == 0 else text, "x", None))
    docs += [(60, None, None, None), (61, "", None, None), (None, items[0][1], None, None), (62, prose(rng, 30_000) + items[1][1], None, None), (62, prose(rng, 10) + items[1][1], None, None)]

    def share(p, t, least):
        p, t = codes.fold_text(p), codes.fold_text(t)
        grams = {t[j : j + least] for j in range(len(t) - least + 1)}
        hit = np.zeros(len(p), dtype=bool)
        for j in range(len(p) - least + 1):
            if p[j : j + least] in grams:
                hit[j : j + least] = True
        return hit.mean()

    want = {(i, d) for i, p, lang, _ in items if p for d, t, *_ in docs if d is not None and t and share(p, t, leakage.stretch_of(lang)) >= 0.5}
    for at_once in (20_000, 4):
        got = {(r["item_id"], r["doc_id"]) for r in leakage.leaked_passages(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, EVAL), items_at_once=at_once).collect()}
        assert got == want and len(want) > 10
    assert leakage.leaked_passages(spark.createDataFrame([], DOC), spark.createDataFrame(items, EVAL)).count() == 0 and leakage.leaked_passages(spark.createDataFrame(docs, DOC), spark.createDataFrame([], EVAL)).count() == 0


# --- 9 sentences ---------------------------------------------------------------------------------------------------

TEXTS = [
    ("第一章 总则\n债务人应当通知债权人。某局答复称：“申请不予受理。”\n债权人可以起诉。他说：“材料已送达。签字没有。”并请求退还差额。", "flow"),
    ("Dr. Smith of Acme Ltd. measured 3.5 mm, i.e. less than allowed. The holder paid 40 marks. The clerk said nothing... until May. See No. 5, vol. 3.", "flow"),
    ("Am 3. März prüfte die Behörde den Vertrag. Dies gilt z. B. für Waren. Der Käufer zahlt.", "flow"),
    ("1. The buyer pays the\nprice. The seller\ndelivers.\n\n2. The court decides.", "wrapped"),
    ("ผู้เช่าต้องชำระค่าปรับภายใน 13 วัน ผู้ขนส่งมีสิทธิแจ้ง เจ้าหนี้ต้องคืนทรัพย์", "flow"),
    ("वाहक जमा राशि लौटाएगा। पंजीयक 3.5 प्रतिशत देगा।", "flow"),
]


def fitted():
    rng = random.Random(3)
    sample = [(t, lay) for t, lay in TEXTS for _ in range(30)]
    starts = ["The holder", "The court", "See the file", "Der Käufer", "Am Montag", "Dies", "A buyer"]
    sample += [("\n".join(f"{rng.choice(starts)} pays {rng.choice(['the price', '40 marks', 'the fee'])}." for _ in range(4)), "flow") for _ in range(60)]
    sample += [(f"{rng.choice(['某局', '该院'])}答复称：“{rng.choice(['申请不予受理', '已经收到'])}。”\n债权人可以起诉。\n债务人应当付款。他说：“已送达。”并请求退款。", "flow") for _ in range(60)]
    return sentences.fit(sample)


def test_sentences():
    model = fitted()

    def split(k):
        text, at, out = TEXTS[k][0], 0, []
        for end in model.ends(*TEXTS[k]):
            out.append(text[at:end].strip())
            at = end
        return out

    assert split(0) == ["第一章 总则", "债务人应当通知债权人。", "某局答复称：“申请不予受理。”", "债权人可以起诉。", "他说：“材料已送达。签字没有。”并请求退还差额。"]
    assert split(1)[0] == "Dr. Smith of Acme Ltd. measured 3.5 mm, i.e. less than allowed." and split(1)[-1] == "See No. 5, vol. 3."
    assert split(2)[0] == "Am 3. März prüfte die Behörde den Vertrag." and split(2)[-1] == "Der Käufer zahlt."
    assert split(3) == ["1. The buyer pays the\nprice.", "The seller\ndelivers.", "2. The court decides."]
    assert split(4) == ["ผู้เช่าต้องชำระค่าปรับภายใน 13 วัน", "ผู้ขนส่งมีสิทธิแจ้ง", "เจ้าหนี้ต้องคืนทรัพย์"] and len(split(5)) == 2


@pytest.mark.parametrize(("script", "left", "mark", "right"), [("cjk", "<cjk>", "。", "债"), ("latin", "fee", "!", "The"), (chr(0x0900 >> 7), "है", "।", "वह"), (chr(0x0600 >> 7), "كلمة", "؟", "هو"), (sentences._THAI, "<letter>", " ", "ผู้")])
def test_counts_overrule_the_prior_of_a_mark(script, left, mark, right):
    key = sentences._PART.join((left, mark, right))
    assert sentences.Model().decide([script], [key]).tolist() == [True]
    model = sentences.Model(words={left, right})
    model.seen[left, mark] = model.seen[mark] = 5000
    assert model.decide([script], [key]).tolist() == [False]


def test_an_event_right_after_an_event_is_learnt():
    model = sentences.Model()
    model.event["near"], model.seen["near"] = 0.0, 100.0
    alone = model.run_posteriors([(0.4, 0.6)])[0]
    first, second = model.run_posteriors([(0.4, 0.6), (0.3, 0.7)])
    assert alone == pytest.approx(0.6) and first < alone and second < 0.7 and first + second < 1.0
    model.event["near"] = 100.0
    assert model.run_posteriors([(0.4, 0.6), (0.3, 0.7)]) == pytest.approx([0.6, 0.7], abs=0.02)


def test_sentences_of_dirty_documents(spark):
    schema = "doc_id long, text string, layout string, sent_end int"
    rows = [(k, t, lay, 1) for k, (t, lay) in enumerate(TEXTS)] + [(10, None, "flow", 1), (11, "", None, 1), (12, "  \n \n", "wrapped", 1), (13, "无标点的文本", None, 1), (14, "句子。" * 20_000, "flow", 1), (14, "句子。" * 20_000, "flow", 1), (None, "x.", None, None)]
    got = sentences.split_sentences(spark.createDataFrame(rows, schema))
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts[13] == 1 and counts[14] == 40_000 and not {10, 11, 12} & counts.keys() and counts[None] == 1
    assert got.filter("sent_start >= sent_end").count() == 0
    assert sentences.split_sentences(spark.createDataFrame([], schema)).count() == 0


def test_sentences_are_fitted_on_all_texts(spark):
    schema = "doc_id long, text string, layout string"
    long = "\n".join(f"The buyer {k} pays qualb. Osterman the price of the goods. The court decides." for k in range(80))
    assert len(long) > 4_000
    rows = [(k, "The holder pays the fee. The court decides the case.\nThe buyer pays.", "flow") for k in range(50)] + [(99, long, "flow"), (100, None, "flow")]
    documents = spark.createDataFrame(rows, schema)
    ends = {r["sent_end"] for r in sentences.split_sentences(documents).filter("doc_id = 99").collect()}
    at = [m.end() for m in re.finditer("qualb\\.", long)]
    assert not ends & set(at) and len(ends) == 160
    whole, local = sentences.fit_all(sentences.parsed_texts(documents.filter("text IS NOT NULL"))), sentences.fit([(t, lay) for _, t, lay in rows if t])
    assert whole.words == local.words and "qualb" in whole.words
    assert all(whole.event[k] == pytest.approx(local.event[k], abs=1e-3) for k in local.event)


def test_splitting_knows_all_kinds(spark):
    kinds = [f"kind {k}" for k in range(1_500)]
    limits = spark.createDataFrame([(k, "characters", 20, 5) for k in kinds], LIMIT)
    items = spark.createDataFrame([(k, "a", "x" * 30, None, None) for k in kinds], ITEM)
    assert splitting.oversized(splitting.split_items(items, limits)).count() == 1_500

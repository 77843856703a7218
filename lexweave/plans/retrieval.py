"""Catalogue entries of ranking, routing and evaluation.

Query vectors are the rows whose id is divisible by 50, matched against all rows; query texts are the evaluation items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import evaluation, retrieval
from lexweave.session import materialize, spread, table


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.filter(F.col("vec_id") % 50 == 0), rows


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "query", "query_type", "difficulty", "lang")
    return items, spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def dense_topk(spark, sf_dir):
    return retrieval.dense_topk(*_vectors(spark, sf_dir), k=10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def dense_topk_filtered(spark, sf_dir):
    queries, rows = _vectors(spark, sf_dir)
    allowed = spark.createDataFrame([(n,) for n in (1, 3, 5)], "label int")
    return retrieval.dense_topk(queries, rows.join(F.broadcast(allowed), "label", "left_semi"), k=5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def similarity_quantiles(spark, sf_dir):
    return retrieval.similarity_quantiles(*_vectors(spark, sf_dir))


def bm25_topk(spark, sf_dir):
    return retrieval.bm25(*_texts(spark, sf_dir), k=10)


def _candidates(spark, sf_dir):
    items, texts = _texts(spark, sf_dir)
    hits = retrieval.bm25(items, texts, k=30).select("query_id", "doc_id", F.col("rank").alias("position"))
    return materialize(hits.join(items.select("query_id", "query"), "query_id").join(texts, "doc_id"))  # 30 texts a query, read four times


def bm25_candidates(spark, sf_dir):
    return retrieval.bm25_candidates(_candidates(spark, sf_dir))


def rrf_fusion(spark, sf_dir):
    first = _candidates(spark, sf_dir)
    return retrieval.rrf([first.select("query_id", "doc_id", F.col("position").alias("rank")), retrieval.bm25_candidates(first).select("query_id", "doc_id", "rank")])


def hybrid_final(spark, sf_dir):
    """Titles of the documents whose id is divisible by 50 as questions; three documents in a row share a parent."""
    queries, rows = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "text")
    questions = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    children = docs.select("doc_id", F.expr("doc_id div 3").alias("parent_id"), "text")
    parents = docs.filter("doc_id % 3 = 0").select(F.expr("doc_id div 3").alias("parent_id"), F.col("text").alias("content"))
    return retrieval.hybrid(queries, questions, rows, children, parents).select("query_id", "parent_id", "rerank_score", "final_rank")


def rerank_final(spark, sf_dir):
    first = _candidates(spark, sf_dir).select("query_id", "query", "doc_id", "text", F.col("position").alias("rank"))
    return retrieval.rerank(first, pool=12).select("query_id", "doc_id", "rerank_score", "final_rank")


def parent_first_hit(spark, sf_dir):
    children = table(spark, sf_dir, "legal_child_v2").select("child_id", "external_parent_id", "content").dropDuplicates(["child_id"])
    items, _ = _texts(spark, sf_dir)
    hits = retrieval.bm25(items, children.select(F.col("child_id").alias("doc_id"), F.col("content").alias("text")), k=20)
    ranked = hits.join(children.select(F.col("child_id").alias("doc_id"), F.col("external_parent_id").alias("parent_id")), "doc_id")
    parents = table(spark, sf_dir, "legal_parent_contract_v1").groupBy(F.col("external_parent_id").alias("parent_id")).agg(F.max("content").alias("content"))
    return retrieval.recall_parents(ranked, parents).select("query_id", "parent_id", F.col("doc_id").alias("child_id"), "rank", "parent_rank")


def faq_route(spark, sf_dir):
    queries, rows = _vectors(spark, sf_dir)
    others = retrieval.dense_topk(queries, rows, k=4).filter(F.col("query_id") != F.col("vec_id"))
    ranked = retrieval.top_k(others.drop("rank"), ["query_id"], "similarity", ["vec_id"], 3)
    return retrieval.faq_route(ranked.withColumn("answer", F.concat(F.lit("answer "), F.col("vec_id").cast("string"))), direct=0.6, context=0.3)


def route_precedence(spark, sf_dir):
    f = F.col("verdict_id")
    states = table(spark, sf_dir, "citation_verdicts").select("verdict_id", "query_id", "status").distinct().select(
        F.concat_ws("/", "query_id", f.cast("string"), "status").alias("query_id"),
        (f % 13 == 0).alias("has_attachment"), (f % 11 == 0).alias("exact_hit"), (f % 7 == 0).alias("semantic_hit"), (f % 5 != 0).alias("professional"),
        F.when(f % 17 == 0, "faq_direct").when(f % 3 == 0, "faq_context").otherwise("none").alias("faq"), (f % 4).alias("n_hits"), (f % 6).alias("n_passages"),
    )
    return retrieval.final_route(states).groupBy("route").agg(F.count("*").alias("n"))


def _results(spark, sf_dir):
    """Ranked neighbours as results of two strategies: relevant are rows of the query's label."""
    queries, rows = _vectors(spark, sf_dir)
    labels = rows.select(F.col("vec_id"), "label")
    hits = retrieval.dense_topk(queries, rows, k=11).filter(F.col("query_id") != F.col("vec_id"))
    exact = retrieval.top_k(hits.drop("rank"), ["query_id"], "similarity", ["vec_id"], 10)
    coarse = retrieval.top_k(hits.drop("rank").withColumn("similarity", F.round("similarity", 1)), ["query_id"], "similarity", ["vec_id"], 10)
    both = exact.withColumn("strategy", F.lit("A")).unionByName(coarse.withColumn("strategy", F.lit("B")))
    named = both.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return named.select(
        "strategy", "query_id", "rank", (F.col("label") == F.col("wanted")).alias("hit"), ((F.col("label") == F.col("wanted")) & (F.col("rank") <= 3)).alias("cite_hit"),
        F.concat(F.lit("type"), (F.col("wanted") % 3).cast("string")).alias("query_type"), F.when(F.col("wanted") < 3, "hard").when(F.col("wanted") < 6, "medium").otherwise("easy").alias("difficulty"),
    )


def recall_mrr(spark, sf_dir):
    return evaluation.metrics(_results(spark, sf_dir))


def failure_samples(spark, sf_dir):
    return evaluation.failure_samples(evaluation.paired(_results(spark, sf_dir), "A", "B"))


def bootstrap_interval(spark, sf_dir):
    pairs = evaluation.paired(_results(spark, sf_dir), "A", "B")
    return evaluation.bootstrap_interval(pairs, evaluation.draws_table(spark, pairs.count()))


def release_gate(spark, sf_dir):
    return evaluation.release_gate(evaluation.metrics(_results(spark, sf_dir)), "A", "B")


def embedding_quality(spark, sf_dir):
    return evaluation.embedding_quality(table(spark, sf_dir, "embeddings"), 64)


def latency_summary(spark, sf_dir):
    return evaluation.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value")


QUERIES = {f.__name__: f for f in (dense_topk, dense_topk_filtered, similarity_quantiles, bm25_topk, bm25_candidates, rrf_fusion, rerank_final, hybrid_final, parent_first_hit, faq_route, route_precedence, recall_mrr, failure_samples, bootstrap_interval, release_gate, embedding_quality, latency_summary)}


def _dense(where: str = "", k: int = 10) -> str:
    return f"""
d AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 {where}),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM d QUALIFY r <= {k})"""


_TOKENS = "regexp_extract_all(lower({}), '[一-鿿]|[a-zA-Z]+|[0-9]+')"


def _bm25(source: str, doc: str, text: str, k: int) -> str:
    return f"""
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format('query')}) AS term FROM eval_items) GROUP BY ALL),
tk AS (SELECT {doc} AS doc_id, {_TOKENS.format(text)} AS ts FROM {source} WHERE {text} IS NOT NULL),
sz AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM tk),
tf AS (SELECT doc_id, term, len AS l, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM tk) GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw, a FROM df, sz),
idf AS (SELECT term, a, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) * qf), 6) AS score
  FROM tf JOIN idf USING (term) JOIN q USING (term) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM sc QUALIFY rank <= {k})"""


_CANDIDATES = f"""WITH {_bm25('documents', 'doc_id', 'text', 30)},
cand AS (SELECT query_id, doc_id, rank AS position, query, text FROM bm JOIN (SELECT item_id AS query_id, query FROM eval_items) USING (query_id) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)),"""
_OVER = f"""
ctk AS (SELECT query_id, doc_id, {_TOKENS.format('text')} AS ts FROM cand),
cav AS (SELECT query_id, avg(len(ts)) AS a, count(*) AS n FROM ctk GROUP BY 1),
ctf AS (SELECT query_id, doc_id, term, l, count(*) AS tf FROM (SELECT query_id, doc_id, len(ts) AS l, unnest(ts) AS term FROM ctk) GROUP BY ALL),
craw AS (SELECT query_id, term, a, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT query_id, term, count(*) AS df FROM ctf GROUP BY ALL) JOIN cav USING (query_id)),
cfl AS (SELECT query_id, 0.25::DOUBLE * avg(raw) AS floor FROM craw GROUP BY 1),
cs AS (SELECT query_id, doc_id, sum(qf * (CASE WHEN raw < 0 THEN floor ELSE raw END) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))) AS s
  FROM q JOIN craw USING (query_id, term) JOIN cfl USING (query_id) JOIN ctf USING (query_id, term) GROUP BY ALL),
cb AS (SELECT c.query_id, c.doc_id, CASE WHEN n > 1 THEN round(coalesce(s, 0), 6) END AS score, position FROM cand c JOIN cav USING (query_id) LEFT JOIN cs USING (query_id, doc_id)),
cr AS (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, position))::INTEGER AS rank FROM cb)"""
_CANDIDATES += _OVER

_RESULTS = f"""WITH {_dense(k=11)},
hits AS (SELECT query_id, vec_id, s FROM top WHERE query_id <> vec_id),
ex AS (SELECT 'A' AS strategy, query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM hits QUALIFY rank <= 10),
co AS (SELECT 'B' AS strategy, query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 1) DESC, vec_id) AS rank FROM hits QUALIFY rank <= 10),
res AS (SELECT strategy, query_id, rank, h.label = w.label AS hit, h.label = w.label AND rank <= 3 AS cite_hit, 'type' || (w.label % 3) AS query_type,
  CASE WHEN w.label < 3 THEN 'hard' WHEN w.label < 6 THEN 'medium' ELSE 'easy' END AS difficulty
  FROM (SELECT * FROM ex UNION ALL SELECT * FROM co) x JOIN embeddings h ON h.vec_id = x.vec_id JOIN embeddings w ON w.vec_id = query_id),
pq AS (SELECT strategy, query_type, difficulty, query_id, max(hit::INT) AS hit, min(rank) FILTER (hit) AS first_rank, max(cite_hit::INT) AS cite_hit, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0) AS rr FROM res GROUP BY ALL),
met AS (SELECT strategy, coalesce(query_type, 'ALL') AS query_type, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(hit), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(cite_hit), 6) AS cite_hit_rate
  FROM pq GROUP BY GROUPING SETS ((strategy), (strategy, query_type)))"""

SQL = {
    "dense_topk": f"WITH {_dense()} SELECT query_id, vec_id, round(s, 6) AS similarity, r::INTEGER AS rank FROM top",
    "dense_topk_filtered": f"WITH {_dense('AND c.label IN (1, 3, 5)', 5)} SELECT query_id, vec_id, round(s, 6) AS similarity, r::INTEGER AS rank FROM top",
    "similarity_quantiles": """
WITH p AS (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND (b.vec_id % 50 <> 0 OR a.vec_id < b.vec_id))
SELECT count(*) AS n_pairs, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99, round(max(s), 6) AS p100,
  round(least(max(s) + 0.03::DOUBLE, 0.97::DOUBLE), 6) AS threshold FROM p""",
    "bm25_topk": f"WITH {_bm25('documents', 'doc_id', 'text', 10)} SELECT * FROM bm",
    "bm25_candidates": _CANDIDATES + " SELECT * FROM cr",
    "rrf_fusion": _CANDIDATES + """,
li AS (SELECT query_id, doc_id, position AS rank, 0 AS list_no FROM cand UNION ALL SELECT query_id, doc_id, rank, 1 FROM cr),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) FILTER (list_no = 0) AS r0 FROM li GROUP BY ALL)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, doc_id))::INTEGER AS rank FROM fu QUALIFY rank <= 30""",
    "rerank_final": _CANDIDATES + f""",
ov AS (SELECT query_id, doc_id, position, round(len(list_intersect(list_distinct({_TOKENS.format('query')}), list_distinct({_TOKENS.format('text')})))::DOUBLE / len(list_distinct({_TOKENS.format('query')})), 6) AS rerank_score FROM cand WHERE position <= 12)
SELECT query_id, doc_id, rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, position))::INTEGER AS final_rank FROM ov QUALIFY final_rank <= 5""",
    "hybrid_final": f"""WITH {_dense(k=60)},
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT doc_id AS query_id, unnest({_TOKENS.format('title')}) AS term FROM documents WHERE doc_id % 50 = 0 AND trim(title) <> '') GROUP BY ALL),
cand AS (SELECT t.query_id, t.vec_id AS doc_id, r AS position, a.title AS query, d.text FROM top t JOIN documents a ON a.doc_id = t.query_id JOIN documents d ON d.doc_id = t.vec_id WHERE trim(a.title) <> '' AND d.text IS NOT NULL),
{_OVER},
li AS (SELECT query_id, doc_id, position AS rank, 0 AS list_no FROM cand UNION ALL SELECT query_id, doc_id, rank, 1 FROM cr),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) FILTER (list_no = 0) AS r0 FROM li GROUP BY ALL),
f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, doc_id) AS rank FROM fu QUALIFY rank <= 30),
p AS (SELECT query_id, doc_id // 3 AS parent_id, min(rank) AS rank FROM f GROUP BY ALL),
pr AS (SELECT p.query_id, p.parent_id, a.title AS query, d.text, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS prank FROM p JOIN documents d ON d.doc_id = 3 * p.parent_id JOIN documents a ON a.doc_id = p.query_id WHERE trim(d.text) <> ''),
ov AS (SELECT *, CASE WHEN len(list_distinct({_TOKENS.format('query')})) > 0 THEN round(len(list_intersect(list_distinct({_TOKENS.format('query')}), list_distinct({_TOKENS.format('text')})))::DOUBLE / len(list_distinct({_TOKENS.format('query')})), 6) END AS rerank_score FROM pr WHERE prank <= 12)
SELECT query_id, parent_id, rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, prank))::INTEGER AS final_rank FROM ov QUALIFY final_rank <= 5""",
    "parent_first_hit": f"""WITH ch AS (SELECT DISTINCT child_id, external_parent_id, content FROM legal_child_v2), {_bm25('ch', 'child_id', 'content', 20)},
p AS (SELECT external_parent_id AS parent_id, max(content) AS content FROM legal_parent_contract_v1 GROUP BY 1),
f AS (SELECT query_id, external_parent_id AS parent_id, doc_id AS child_id, rank FROM bm JOIN ch ON child_id = doc_id QUALIFY row_number() OVER (PARTITION BY query_id, external_parent_id ORDER BY rank) = 1)
SELECT query_id, parent_id, child_id, rank, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS parent_rank FROM f JOIN p USING (parent_id) WHERE trim(content) <> ''""",
    "faq_route": f"""WITH {_dense(k=4)}, h AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM top WHERE query_id <> vec_id QUALIFY n <= 3),
g AS (SELECT query_id, max('answer ' || vec_id) FILTER (n = 1 AND s >= 0.6) AS direct_answer, count(*) FILTER (s >= 0.3) AS n_context, round(max(s), 6) AS top_similarity FROM h GROUP BY 1)
SELECT *, CASE WHEN direct_answer IS NOT NULL THEN 'faq_direct' WHEN n_context > 0 THEN 'faq_context' ELSE 'none' END AS route FROM g""",
    "route_precedence": """
WITH s AS (SELECT DISTINCT verdict_id AS v, query_id, status FROM citation_verdicts)
SELECT CASE WHEN v % 13 <> 0 AND v % 11 = 0 THEN 'exact_cache' WHEN v % 13 <> 0 AND v % 7 = 0 THEN 'semantic_cache' WHEN v % 13 <> 0 AND v % 5 = 0 THEN 'non_professional'
  WHEN v % 13 <> 0 AND v % 17 = 0 THEN 'faq_direct' WHEN v % 13 <> 0 AND v % 17 <> 0 AND v % 3 = 0 THEN 'faq_context' WHEN v % 4 = 0 THEN 'no_hit' WHEN v % 6 = 0 THEN 'no_passage' ELSE 'rag' END AS route, count(*) AS n FROM s GROUP BY 1""",
    "recall_mrr": _RESULTS + " SELECT * FROM met",
    "failure_samples": _RESULTS + """,
pr AS (SELECT query_id, difficulty, max(hit) FILTER (strategy = 'A') AS ha, max(hit) FILTER (strategy = 'B') AS hb, max(first_rank) FILTER (strategy = 'A') AS fa, max(first_rank) FILTER (strategy = 'B') AS fb FROM pq GROUP BY ALL),
bk AS (SELECT *, CASE WHEN ha = 1 AND hb = 0 THEN 'a_hit_b_miss' WHEN ha = 0 AND hb = 1 THEN 'a_miss_b_hit' WHEN ha = 0 AND hb = 0 THEN 'both_miss' WHEN abs(fa - fb) >= 3 THEN 'rank_gap' END AS bucket FROM pr)
SELECT bucket, (row_number() OVER (PARTITION BY bucket ORDER BY CASE difficulty WHEN 'hard' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, query_id))::INTEGER AS place, query_id, difficulty FROM bk WHERE bucket IS NOT NULL QUALIFY place <= 5""",
    "release_gate": _RESULTS + """,
v AS (SELECT max(recall) FILTER (strategy = 'A') AS recall_a, max(recall) FILTER (strategy = 'B') AS recall_b, max(cite_hit_rate) FILTER (strategy = 'A') AS cite_a, max(cite_hit_rate) FILTER (strategy = 'B') AS cite_b FROM met WHERE query_type = 'ALL')
SELECT *, CASE WHEN recall_b >= recall_a AND cite_b >= cite_a - 0.03::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS gate FROM v""",
    "embedding_quality": "SELECT count(*) AS n_rows, count(*) - count(DISTINCT vec_id) AS n_repeated, count(*) FILTER (len(embedding) <> 64) AS n_wrong_dimension, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) >= 1e-4) AS n_not_unit FROM embeddings",
    "latency_summary": 'SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS "max" FROM events GROUP BY 1',
}

"""Ranking: exact dense top-k, BM25, reciprocal-rank fusion, parent recall, reranking and routes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import search_tokens
from lexweave.session import materialize, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
DENSE_K, CHILD_K, RERANK_POOL, FINAL_K = 60, 30, 12, 5
QUERY_BLOCK = 2_000  # query vectors held by a worker at once
DIRECT_SIMILARITY, CONTEXT_SIMILARITY, CONTEXT_ROWS = 0.99, 0.85, 3


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero, null where the dimensions differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def top_k(rows: DataFrame, by: list[str], score: str, tie: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ties by ``tie``; partial limits keep a group's rows from meeting in one task."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie)
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def _block_scores(ids: list, matrix: np.ndarray, k: int, others: bool):
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms == 0, 1, norms)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s = np.full((len(ids), 0), 0.0)
        best_i = np.empty((len(ids), 0), dtype=np.int64)
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()) if i is not None and v is not None and len(v) == matrix.shape[1] and None not in v]
            if not rows:
                continue
            x = np.array([v for _, v in rows], dtype=np.float64)
            if not np.isfinite(x).all():
                raise ValueError("a vector holds a value that is not finite")
            n = np.linalg.norm(x, axis=1)
            scores = np.round(unit @ (x / np.where(n == 0, 1, n)[:, None]).T, 9)
            if others:
                scores[np.array(ids, dtype=np.int64)[:, None] == np.array([i for i, _ in rows], dtype=np.int64)[None, :]] = -np.inf
            best_s = np.concatenate([best_s, scores], axis=1)
            best_i = np.concatenate([best_i, np.broadcast_to(np.array([i for i, _ in rows], dtype=np.int64), scores.shape)], axis=1)
            order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        flat = np.repeat(np.arange(len(ids)), best_s.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in flat], pa.int64()), pa.array(best_i.ravel(), pa.int64()), pa.array(best_s.ravel(), pa.float64())], ["query_id", "vec_id", "similarity"])

    return run


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = DENSE_K, block: int = QUERY_BLOCK, others: bool = False) -> DataFrame:
    """Exact cosine top-k of each query vector over all rows (J7, T2), by matrix products per partition.

    ``queries`` and ``corpus``: vec_id, embedding. Queries are taken in blocks of bounded size, and each partition of
    the corpus passes on its k best rows of a query only. Vectors of another dimension or with nulls match nothing; a
    value that is not finite is an error; ties go to the lower id. With ``others`` a query does not match its own id.
    """
    n = queries.count()
    wanted = queries.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = corpus.select(F.col("vec_id").cast("long"), "embedding")
    passes, out = max(1, math.ceil(n / block)), None
    for p in range(passes):
        part = [(r["vec_id"], r["embedding"]) for r in wanted.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toLocalIterator()]
        if not part:
            continue
        found = rows.mapInArrow(_block_scores([i for i, _ in part], np.array([v for _, v in part], dtype=np.float64), k, others), "query_id long, vec_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
    return top_k(out.filter(F.col("similarity") > float("-inf")) if others else out, ["query_id"], "similarity", ["vec_id"], k)


_TOKEN = re.compile(r"[一-鿿]|[a-zA-Z]+|[0-9]+")  # as ``search_tokens``


def term_table(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``length`` and the distinct search tokens of each text as ``terms`` (term, tf), counted where the text is.

    Two tokens out of three repeat, so a text leaves this far smaller than exploded. A null text has no terms.
    """
    types = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
        for batch in batches:
            counts = [Counter(_TOKEN.findall(t.lower())) if t else Counter() for t in batch.column(batch.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
            terms = pa.StructArray.from_arrays([pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int32())], ["term", "tf"])
            length = pa.array([c.total() for c in counts], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), length, pa.ListArray.from_arrays(pa.array(ends), terms).cast(kind)], [*keys, "length", "terms"])

    return texts.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", length int, terms array<struct<term:string,tf:int>>")


def bm25(queries: DataFrame, documents: DataFrame, k: int = DENSE_K) -> DataFrame:
    """BM25 top-k of ``documents`` (doc_id, text) for each of ``queries`` (query_id, query) over the whole corpus.

    One pass counts the documents of every term, and, under the empty term, the documents and tokens in all; each task
    adds up before the shuffle, and the table of the vocabulary is written once. A second pass counts the terms of the
    queries only, cut by a semi-join before any shuffle. Negative inverse frequencies are floored at ``EPSILON`` of
    the mean over the whole vocabulary; repeated query terms count again; a term absent from the corpus adds nothing.
    """
    asked = queries.select("query_id", F.explode(search_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    counted = term_table(documents.filter(F.col("text").isNotNull()), ["doc_id"])
    vocabulary = materialize(counted.select("length", F.explode(F.concat("terms.term", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("n_tokens")))
    size = vocabulary.filter("term = ''").select(F.col("df").alias("n_docs"), (F.col("n_tokens") / F.col("df")).alias("avg_length"))  # one row
    idf = vocabulary.filter("term <> ''").select("term", "df").crossJoin(F.broadcast(size)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = idf.agg((EPSILON * F.avg("raw")).alias("floor"))  # one row
    terms = asked.select("term").distinct()
    weights = idf.join(terms, "term", "left_semi").crossJoin(F.broadcast(floor)).select("term", "avg_length", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    counts = counted.select("doc_id", "length", F.inline("terms")).join(terms, "term", "left_semi")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = counts.join(weights, "term").select("doc_id", "term", gain.alias("gain")).join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("gain") * F.col("qf")), 6).alias("score"))
    return top_k(scored, ["query_id"], "score", ["doc_id"], k)


def bm25_candidates(candidates: DataFrame) -> DataFrame:
    """BM25 of each query over its own candidates only (R2, T3), ties in the candidates' order.

    ``candidates``: query_id, query, doc_id, text, position. A query with one candidate keeps it, unscored.
    """
    counted = term_table(spread(candidates.select("doc_id", "text").dropDuplicates(["doc_id"])), ["doc_id"])  # a text that many queries hit is read once
    tokens = candidates.select("query_id", "doc_id").join(counted, "doc_id")
    sizes = tokens.groupBy("query_id").agg(F.avg("length").alias("avg_length"), F.count("*").alias("n"))
    df = tokens.select("query_id", F.explode("terms.term").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df")).join(sizes, "query_id").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    asked = candidates.select("query_id", "query").distinct().select("query_id", F.explode(search_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    # one row a term of the query, and one a query with the mean over all terms of its candidates
    known = df.join(asked, ["query_id", "term"], "left").groupBy("query_id").agg((EPSILON * F.avg("raw")).alias("floor"), F.collect_list(F.when(F.col("qf").isNotNull(), F.struct("term", "qf", "raw", "avg_length"))).alias("terms"))
    weights = known.select("query_id", "floor", F.explode("terms").alias("t")).select("query_id", "t.*", F.when(F.col("t.raw") < 0, F.col("floor")).otherwise(F.col("t.raw")).alias("idf"))
    tf = tokens.select("query_id", "doc_id", "length", F.inline("terms")).join(asked.select("query_id", "term"), ["query_id", "term"], "left_semi")
    gain = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scores = weights.join(tf, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(gain).alias("s"))
    sized = candidates.select("query_id", "doc_id", "position").join(sizes.select("query_id", "n"), "query_id")
    scored = sized.select("query_id", "doc_id", "position", "n").join(scores, ["query_id", "doc_id"], "left").withColumn("score", F.when(F.col("n") > 1, F.round(F.coalesce("s", F.lit(0.0)), 6)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "position")
    return scored.select("query_id", "doc_id", "score", F.row_number().over(order).alias("rank"))


def rrf(lists: list[DataFrame], k: int = RRF_K, cut: int = CHILD_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, doc_id, rank), ties by first appearance (G1, T4)."""
    out = None
    for n, ranked in enumerate(lists):
        part = ranked.select("query_id", "doc_id", "rank", F.lit(n).alias("list_no"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("raw"), F.min(F.struct("list_no", "rank")).alias("first"))
    fused = fused.select("query_id", "doc_id", F.round("raw", 9).alias("score"), F.col("first.list_no").alias("list_no"), F.col("first.rank").alias("list_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "list_no", "list_rank", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cut).select("query_id", "doc_id", "score", "rank")


def recall_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents of ranked child hits; the first child of a parent gives its place, blank parents fall out.

    ``hits``: query_id, parent_id, rank, further columns; ``parents``: parent_id, content.
    """
    first = Window.partitionBy("query_id", "parent_id").orderBy("rank")
    best = hits.withColumn("n", F.row_number().over(first)).filter(F.col("n") == 1).drop("n")
    joined = best.join(parents.filter(F.trim("content") != ""), "parent_id")
    return joined.withColumn("parent_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Default rerank score: share of the query's distinct tokens that the text holds."""
    q, t = F.array_distinct(search_tokens(query)), F.array_distinct(search_tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_overlap, pool: int | None = None, k: int = FINAL_K) -> DataFrame:
    """The k best of each query by a pluggable score; unscored hits keep the fused order behind scored ones.

    ``hits``: query_id, query, doc_id, text, rank.
    """
    pooled = hits if pool is None else hits.filter(F.col("rank") <= pool)
    scored = pooled.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)


def hybrid(query_vectors: DataFrame, questions: DataFrame, vectors: DataFrame, children: DataFrame, parents: DataFrame, dense_k: int = DENSE_K, child_k: int = CHILD_K, pool: int = RERANK_POOL, k: int = FINAL_K) -> DataFrame:
    """Dense hits, BM25 over them, both fused, their parents, and the parents reranked: 60, 60, 30, pool, 5.

    ``query_vectors`` and ``vectors``: vec_id, embedding; ``questions``: query_id (a vec_id), query; ``children``:
    doc_id (a vec_id), parent_id, text; ``parents``: parent_id, content. Texts are joined to at most ``dense_k`` hits a
    query. A question without a vector, a child without a text or parent, and a blank parent fall out.
    """
    hits = materialize(dense_topk(query_vectors, vectors, dense_k).select("query_id", F.col("vec_id").alias("doc_id"), F.col("rank").alias("position")))
    asked = questions.filter(F.trim("query") != "").select("query_id", "query")
    texts = children.filter(F.col("text").isNotNull()).select("doc_id", "parent_id", "text")
    candidates = materialize(hits.join(asked, "query_id").join(texts, "doc_id"))
    fused = rrf([candidates.select("query_id", "doc_id", F.col("position").alias("rank")), bm25_candidates(candidates).select("query_id", "doc_id", "rank")], cut=child_k)
    recalled = recall_parents(fused.join(candidates.select("query_id", "query", "doc_id", "parent_id"), ["query_id", "doc_id"]).select("query_id", "query", "parent_id", "rank"), parents)
    return rerank(recalled.select("query_id", "query", F.col("parent_id").alias("doc_id"), F.col("content").alias("text"), F.col("parent_rank").alias("rank")), pool=pool, k=k).select("query_id", F.col("doc_id").alias("parent_id"), "rank", "rerank_score", "final_rank")


def faq_route(hits: DataFrame, direct: float = DIRECT_SIMILARITY, context: float = CONTEXT_SIMILARITY, rows: int = CONTEXT_ROWS) -> DataFrame:
    """Route of each query by its question hits (query_id, similarity, rank, answer): direct, context or none."""
    best = F.max(F.when((F.col("rank") == 1) & (F.col("similarity") >= direct) & (F.trim("answer") != ""), F.col("answer")))
    used = F.count_if((F.col("rank") <= rows) & (F.col("similarity") >= context))
    return hits.groupBy("query_id").agg(best.alias("direct_answer"), used.alias("n_context"), F.round(F.max("similarity"), 6).alias("top_similarity")).withColumn("route", F.when(F.col("direct_answer").isNotNull(), "faq_direct").when(F.col("n_context") > 0, "faq_context").otherwise("none"))


def final_route(states: DataFrame) -> DataFrame:
    """The first route whose state holds (R9). ``states``: query_id and one boolean a stage; attachments skip the caches."""
    plain = ~F.coalesce("has_attachment", F.lit(False))
    stages = [("exact_cache", plain & F.col("exact_hit")), ("semantic_cache", plain & F.col("semantic_hit")), ("non_professional", plain & ~F.col("professional")), ("faq_direct", plain & (F.col("faq") == "faq_direct")), ("faq_context", plain & (F.col("faq") == "faq_context")), ("no_hit", F.col("n_hits") == 0), ("no_passage", F.col("n_passages") == 0)]
    route = F.lit("rag")
    for name, holds in reversed(stages):
        route = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(route)
    return states.select("query_id", route.alias("route"))


NANO, BIN = 1_000_000_000, 20_000  # similarities are counted in billionths, first in bins of so many


def _pair_counts(ids: np.ndarray, matrix: np.ndarray, asked: np.ndarray, wanted: np.ndarray | None):
    """Counts of similarities by bin, or by value in the ``wanted`` bins, of one block of queries with all rows."""
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms == 0, 1, norms)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()) if i is not None and v is not None and len(v) == matrix.shape[1] and None not in v]
            for at in range(0, len(rows), 1_000):
                part = rows[at : at + 1_000]
                own, x = np.array([i for i, _ in part], dtype=np.int64), np.array([v for _, v in part], dtype=np.float64)
                if not np.isfinite(x).all():
                    raise ValueError("a vector holds a value that is not finite")
                n = np.linalg.norm(x, axis=1)
                scores = np.rint((unit @ (x / np.where(n == 0, 1, n)[:, None]).T) * NANO).astype(np.int64)
                scores = scores[np.where(np.isin(own, asked)[None, :], ids[:, None] < own[None, :], ids[:, None] != own[None, :])]
                if wanted is None:
                    scores = scores // BIN
                else:
                    scores = scores[np.isin(scores // BIN, wanted)]
                values, counts = np.unique(scores, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["value", "n"])

    return run


def similarity_quantiles(queries: DataFrame, corpus: DataFrame, cap: float = 0.97, margin: float = 0.03, block: int = QUERY_BLOCK) -> DataFrame:
    """Quantiles of the similarities of a query set with all other rows and the cache threshold they suggest.

    ``queries``: the stated query set, rows of ``corpus``; both vec_id, embedding. A pair of two queries counts once, a
    row with itself never. Similarities are counted block by block in bins of fixed width and then by value in the
    bins of the quantiles only, so the result is exact and the driver holds at most one count a bin or a value of
    those bins. Vectors of another dimension or with nulls match nothing; a value that is not finite is an error.
    """
    spark = queries.sparkSession
    rows = corpus.select(F.col("vec_id").cast("long"), "embedding")
    usable = queries.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    asked = np.array(sorted(r["vec_id"] for r in usable.select("vec_id").toLocalIterator()), dtype=np.int64)
    passes = max(1, math.ceil(len(asked) / block))

    def counts(wanted: np.ndarray | None) -> list[tuple[int, int]]:
        total: Counter = Counter()
        for p in range(passes):
            part = [(r["vec_id"], r["embedding"]) for r in usable.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toLocalIterator()]
            if part:
                run = _pair_counts(np.array([i for i, _ in part], dtype=np.int64), np.array([v for _, v in part], dtype=np.float64), asked, wanted)
                for r in rows.mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).toLocalIterator():
                    total[r["value"]] += r["n"]
        return sorted(total.items())

    names, shares = ("p50", "p90", "p95", "p99", "p100"), (0.5, 0.9, 0.95, 0.99, 1.0)
    schema = "n_pairs long, " + ", ".join(f"{x} double" for x in names) + ", threshold double"
    bins = counts(None)
    n = sum(c for _, c in bins)
    if n == 0:
        return spark.createDataFrame([(0, *[None] * 6)], schema)
    places = [x * (n - 1) for x in shares]
    ranks = sorted({r for at in places for r in (math.floor(at), math.ceil(at))})

    def holding(table: list[tuple[int, int]], before: dict[int, int]) -> dict[int, int]:
        """The value at each rank; ``before`` gives the pairs left out just before a value."""
        out, seen, todo = {}, 0, iter(ranks)
        r = next(todo, None)
        for value, c in table:
            seen += before.get(value, 0) + c
            while r is not None and r < seen:
                out[r] = value
                r = next(todo, None)
        return out

    wanted = sorted(set(holding(bins, {}).values()))
    exact = counts(np.array(wanted, dtype=np.int64))
    left, skipped, first = {}, 0, {}
    for value, _ in exact:
        first.setdefault(value // BIN, value)
    for b, c in bins:
        if b in first:
            left[first[b]], skipped = skipped, 0
        else:
            skipped += c
    at_rank = holding(exact, left)
    found = []
    for at in places:
        low, high = at_rank[math.floor(at)] / NANO, at_rank[math.ceil(at)] / NANO
        found.append(low + (high - low) * (at - math.floor(at)))
    return spark.createDataFrame([(n, *[round(x, 6) for x in found], round(min(found[-1] + margin, cap), 6))], schema)

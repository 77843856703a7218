"""Near-duplicate records: banded HyperMinHash registers, corrected estimates, exact verification, groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.codes import code_points, slices
from lexweave.llm.hyperminhash import REGISTERS, shingle_hashes, similarity, sketch
from lexweave.session import materialize

SHINGLE = 5  # characters
THRESHOLD = 0.7
BAND = 5  # registers of a band
BANDS = REGISTERS // BAND
MARGIN = 0.13  # more than four standard errors of an estimate near the threshold
BLOCK = 512  # rows of a bucket that meet in one join cell


def shingles(text: str, size: int = SHINGLE) -> set[str]:
    """Distinct character runs of a text without whitespace, in lower case."""
    t = "".join(text.split()).lower()
    return {t[k : k + size] for k in range(len(t) - size + 1)}


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                plain = pa.array(["".join(t.split()).lower() for t in batch.column("text").to_pylist()], pa.string())
                codes, starts = code_points(plain)
                hashes = shingle_hashes(codes, size)
                owner = np.searchsorted(starts, np.arange(len(hashes)), side="right") - 1
                inside = np.arange(len(hashes)) + size <= starts[owner + 1]
                hashes, owner = hashes[inside], owner[inside]
                n = batch.num_rows
                distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(*(np.searchsorted(owner, np.arange(n), side=s) for s in ("left", "right")))], dtype=np.int32)
                registers = sketch(hashes, owner, n)
                kept = np.flatnonzero(distinct)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest").take(pa.array(kept)), pa.array(distinct[kept]), pa.array([registers[k].tobytes() for k in kept], pa.binary())], ["digest", "n", "registers"]
                )

    return run


def sketches(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``digest``, number of distinct shingles and registers of each distinct text that has a shingle."""
    return texts.mapInArrow(_sketches(size), "digest binary, n int, registers binary").groupBy("digest").agg(F.first("n").alias("n"), F.first("registers").alias("registers"))


def pairs_within(rows: DataFrame, keys: list[str], id_column: str, extra: list[str], condition: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of rows with equal keys, ``a`` below ``b`` by ``id_column``, that meet the condition on ``a_*`` and ``b_*``.

    Keys that stand once are dropped by a count before any row is joined. A key with many rows is cut into blocks of
    about ``block`` rows, and each two blocks meet in a join cell of their own, so no task holds a hot key's rows.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)
    blocks = F.ceil(F.col("n_rows") / block).cast("int")
    multi = rows.join(counts, keys).withColumn("n_blocks", blocks).withColumn("own", F.pmod(F.xxhash64(id_column, F.lit(7)), F.col("n_blocks")).cast("int"))
    left = multi.select(*keys, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("n_blocks") - 1)).alias("j"), *[F.col(c).alias(f"a_{c}") for c in [id_column, *extra]])
    right = multi.select(*keys, F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *[F.col(c).alias(f"b_{c}") for c in [id_column, *extra]])
    a, b = F.col(f"a_{id_column}"), F.col(f"b_{id_column}")
    joined = left.join(right, [*keys, "i", "j"]).filter((F.col("i") < F.col("j")) | (a < b))
    if condition is not None:
        joined = joined.filter(condition)
    swap = a > b
    return joined.select(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"))


def _estimate(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("a_registers", "b_registers"))
            n, m = (np.asarray(batch.column(c)) for c in ("a_n", "b_n"))
            keep = pa.array(np.flatnonzero(similarity(ra, rb, n, m) >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return run


def _verify(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in batches:
            keep, values = [], []
            for k, (a, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "a_text", "b_text")))):
                if a != last:
                    last, known = a, shingles(ta, size)
                other = shingles(tb, size)
                shared = len(known & other)
                share = shared / (len(known) + len(other) - shared)
                if share >= threshold:
                    keep.append(k)
                    values.append(share)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    return run


def alike_texts(texts: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of different texts (``digest``, ``text``) whose shingle sets are alike, with the exact similarity.

    Registers are banded; texts that agree in a band and whose set sizes allow the threshold are candidates; the
    estimate of all registers drops those far below it, and the rest are verified on the texts.
    """
    drawn = materialize(sketches(texts, size))
    bands = drawn.select("digest", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring("registers", k * 2 * BAND + 1, F.lit(2 * BAND))))).alias("band", "key"))
    fits = F.least("a_n", "b_n") >= F.lit(threshold) * F.greatest("a_n", "b_n") - 1e-9
    candidates = pairs_within(bands, ["band", "key"], "digest", ["n"], fits).distinct()
    side = lambda s: drawn.select(F.col("digest").alias(s), F.col("n").alias(f"{s}_n"), F.col("registers").alias(f"{s}_registers"))
    close = materialize(candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_registers", "b_registers").mapInArrow(_estimate(threshold - MARGIN), "a binary, b binary"))
    one = texts.groupBy("digest").agg(F.first("text").alias("text")).join(close.select(F.col("a").alias("digest")).union(close.select("b")).distinct(), "digest", "left_semi")
    with_b = close.join(one.select(F.col("digest").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(one.select(F.col("digest").alias("a"), F.col("text").alias("a_text")), "a")
    return both.select("a", "a_text", "b", "b_text").mapInArrow(_verify(size, threshold), "a binary, b binary, similarity double")


def _prepared(records: DataFrame) -> DataFrame:
    rows = records.select(F.col("record_id").cast("string"), F.col("text").cast("string")).filter(F.col("record_id").isNotNull() & F.col("text").isNotNull())
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def near_duplicates(records: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the records of each text, of ``records`` (record_id, text).

    Returns (``a``, ``b``, ``similarity``) by text digest, and (``record_id``, ``digest``). Null ids and texts are left
    out; a text shorter than a shingle is like nothing; repeated rows count once; an id with several texts is alike
    where one of them is. Every link between different texts is found but for the odds of the bands, 1 in 10,000 at
    the threshold and fewer above it.
    """
    rows = _prepared(records)
    return alike_texts(rows.select("digest", "text"), size, threshold), rows.select("record_id", "digest").distinct()


def alike_pairs(records: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of different record ids whose texts are alike, copies of one text included."""
    links, members = near_duplicates(records, size, threshold)
    long_enough = F.length(F.regexp_replace("text", r"(?U)\s+", "")) >= size
    copied = _prepared(records).filter(long_enough).select("record_id", "digest").distinct()
    within = pairs_within(copied, ["digest"], "record_id", [])
    across = links.join(members.select(F.col("digest").alias("a"), F.col("record_id").alias("x")), "a").join(members.select(F.col("digest").alias("b"), F.col("record_id").alias("y")), "b").filter(F.col("x") != F.col("y"))
    pairs = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return pairs.unionByName(within.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and the least node of its connected component, of undirected edges (``a``, ``b``).

    Each round takes the least label around a node and then that label's own label, so the rounds grow with the
    logarithm of a component's width. Labels are written to the shared folder every round; none reach the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(most_rounds):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        step = materialize(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        labels = step.select("node", "label")
        if step.filter(F.col("was") != F.col("label")).limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def duplicate_classes(records: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row a record id: the class of its text, the class's number of texts and records, and the text's links."""
    links, members = near_duplicates(records, size, threshold)
    links = materialize(links)
    degree = links.select(F.col("a").alias("digest")).union(links.select("b")).groupBy("digest").agg(F.count("*").alias("n_links"))
    classes = members.join(components(links).withColumnRenamed("node", "digest"), "digest", "left").join(degree, "digest", "left")
    rows = classes.select("record_id", F.lower(F.hex(F.coalesce("label", "digest"))).alias("class_id"), "digest", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = rows.select("class_id", "digest").distinct().groupBy("class_id").agg(F.count("*").alias("n_texts"))
    records_of = rows.select("class_id", "record_id").distinct().groupBy("class_id").agg(F.count("*").alias("n_records"))
    return rows.select("record_id", "class_id", "n_links").join(sizes, "class_id").join(records_of, "class_id")

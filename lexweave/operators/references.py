"""References to records that do not exist: orphan detection with compressed bitmaps per key range and period."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.bitmaps import Bitmap
from lexweave.functions.text import canonical_key, micros
from lexweave.session import row_count

UNKNOWN = "unknown"
REFERENCE, TARGET, REMOVAL = 0, 1, 2
KEYS_PER_RANGE = 150_000  # rows one key range may hold on average: about 30 MB in a Python worker
SALTS = 16  # parts in which references to one surviving key are joined

_SWEPT = "space string, key string, period string, kind string, first_us long"


def references(mapping: DataFrame) -> DataFrame:
    """The distinct (child, parent) references with their earliest time and its month.

    Rows with a null parent are left out; a null child is kept as the child of a parent reference.
    """
    rows = mapping.select(canonical_key("child_id").alias("child_id"), canonical_key("external_parent_id").alias("external_parent_id"), micros("created_at").alias("t_us"), F.date_format("created_at", "yyyy-MM").alias("month"))
    return (
        rows.filter(F.col("external_parent_id").isNotNull())
        .groupBy("child_id", "external_parent_id")
        .agg(F.min("t_us").alias("t_us"), F.coalesce(F.min("month"), F.lit(UNKNOWN)).alias("period"))
    )


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range: encode its keys, build the bitmaps, take reference AND-NOT target, decode what survives."""
    codes, words = pd.factorize(pdf["key"], sort=True)
    codes = codes.astype(np.uint32)
    role, period = pdf["role"].to_numpy(), pdf["period"].to_numpy(dtype=object)
    lo, hi = pdf["lo_us"].to_numpy(dtype="float64", na_value=np.nan), pdf["hi_us"].to_numpy(dtype="float64", na_value=np.nan)
    n = len(words)
    target, removal = role == TARGET, role == REMOVAL
    first, last, gone = (np.full(n, np.nan) for _ in range(3))
    first[codes[target]], last[codes[target]], gone[codes[removal]] = lo[target], hi[target], hi[removal]
    month = np.full(n, None, dtype=object)
    month[codes[target]] = period[target]
    present, taken = Bitmap.of(codes[target]), codes[removal]
    removed = Bitmap.of(taken[~present.has(taken) | np.isnan(last[taken]) | (gone[taken] > last[taken])])
    alive = present.and_not(removed)
    alive_codes = alive.codes()
    born = month[alive_codes]
    timeless = np.array([m is None for m in born], dtype=bool)
    before = Bitmap.of(alive_codes[timeless])
    births = {m: Bitmap.of(alive_codes[born == m]) for m in set(born[~timeless])}
    pending = sorted(births)
    refs = role == REFERENCE
    ref_period, ref_code, ref_low = period[refs], codes[refs], lo[refs]
    out: list[pd.DataFrame] = []
    for p in sorted(set(ref_period)):
        mine = ref_period == p
        if p == UNKNOWN:
            allowed = alive
        else:
            while pending and pending[0] < p:
                before = before.union(births[pending.pop(0)])
            allowed = before
        left = Bitmap.of(ref_code[mine]).and_not(allowed).codes()
        if not len(left):
            continue
        earliest = np.full(n, np.nan)
        earliest[ref_code[mine]] = ref_low[mine]
        kind = np.where(removed.has(left), "deleted", np.where(present.has(left), "late", "missing")).astype(object)
        keep = (kind != "late") | (earliest[left] < first[left])
        left, kind = left[keep], kind[keep]
        bound = pd.array(np.where(np.isnan(first[left]), 0, first[left]).astype("int64"), dtype="Int64")
        bound[(kind != "late") | np.isnan(first[left])] = pd.NA
        out.append(pd.DataFrame({"space": pdf["space"].iloc[0], "key": np.asarray(words, dtype=object)[left], "period": p, "kind": kind, "first_us": bound}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"space": [], "key": [], "period": [], "kind": [], "first_us": pd.array([], dtype="Int64")})


def surviving_keys(rows: DataFrame, ranges: int) -> DataFrame:
    """The keys of each period whose reference bit is left after AND-NOT with the targets known by then.

    ``rows``: space, key, role (0 reference, 1 target, 2 removal), period, lo_us, hi_us; one row a key and role, for
    references a key and period. A range holds the keys of one hash slice, never a key's rows, so that a hot key
    costs one bit. Returns space, key, period, kind and, for kind ``late``, the time from which references are fine.
    """
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(ranges)))
    return sliced.groupBy("space", "slice").applyInPandas(_sweep, _SWEPT)


def orphan_references(mapping: DataFrame, parents: DataFrame, deletions: DataFrame, children: DataFrame, keys_per_range: int = KEYS_PER_RANGE, salts: int = SALTS) -> DataFrame:
    """Every dangling reference of ``mapping`` by field, period and kind.

    Ids are compared and given out trimmed and in lower case. Null parents are no references; null children are never
    reported as missing children; null keys of ``parents``, ``deletions`` and ``children`` are ignored; null times of a
    parent are ignored, and a parent whose times are all null is never ``late``. Repeated rows count once; empty
    tables give no target. Further columns of any input are not read.
    """
    refs = references(mapping)
    none = F.lit(None).cast("long")

    def of(space: str, role: int, df: DataFrame) -> DataFrame:
        return df.filter(F.col("key").isNotNull()).select(F.lit(space).alias("space"), "key", F.lit(role).alias("role"), "period", "lo_us", "hi_us")

    def referred(field: str) -> DataFrame:
        return refs.groupBy(F.col(field).alias("key"), "period").agg(F.min("t_us").alias("lo_us")).withColumn("hi_us", none)

    known = parents.select(canonical_key("external_parent_id").alias("key"), micros("created_at").alias("us"), F.date_format("created_at", "yyyy-MM").alias("month")).groupBy("key").agg(F.min("us").alias("lo_us"), F.max("us").alias("hi_us"), F.min("month").alias("period"))
    gone = deletions.select(canonical_key("external_parent_id").alias("key"), micros("deleted_at").alias("us")).groupBy("key").agg(F.max("us").alias("hi_us")).select("key", F.lit(None).cast("string").alias("period"), none.alias("lo_us"), "hi_us")
    there = children.select(canonical_key("child_id").alias("key")).distinct().select("key", F.lit(None).cast("string").alias("period"), none.alias("lo_us"), none.alias("hi_us"))
    total = row_count(mapping) + row_count(parents) + row_count(children)
    ranges = max(1, math.ceil(total / keys_per_range))
    rows = (
        of("external_parent_id", REFERENCE, referred("external_parent_id"))
        .unionByName(of("external_parent_id", TARGET, known))
        .unionByName(of("external_parent_id", REMOVAL, gone))
        .unionByName(of("child_id", REFERENCE, referred("child_id")))
        .unionByName(of("child_id", TARGET, there))
    )
    left = surviving_keys(rows, ranges).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ends = refs.select(
        "child_id",
        "external_parent_id",
        "t_us",
        "period",
        F.explode(
            F.array(
                F.struct(F.lit("external_parent_id").alias("space"), F.col("external_parent_id").alias("key"), F.pmod(F.xxhash64("child_id"), F.lit(salts)).cast("int").alias("salt")),
                F.struct(F.lit("child_id").alias("space"), F.col("child_id").alias("key"), F.pmod(F.xxhash64("external_parent_id"), F.lit(salts)).cast("int").alias("salt")),
            )
        ).alias("end"),
    ).select("child_id", "external_parent_id", "t_us", "period", "end.*")
    found = ends.join(left, ["space", "key", "period", "salt"])
    return found.filter(F.col("first_us").isNull() | (F.col("t_us") < F.col("first_us"))).select(F.col("space").alias("ref_field"), "child_id", "external_parent_id", "period", "kind")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of dangling references by table field, period and kind."""
    return found.groupBy("ref_field", "period", "kind").agg(F.count("*").alias("n_references"), F.count_distinct("child_id").alias("n_children"), F.count_distinct("external_parent_id").alias("n_parents"))

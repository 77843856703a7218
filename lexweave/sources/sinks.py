"""Sinks: staged writes that become visible at once, manifests, versions and deliverables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table and rename, so that readers see the old or the new table and never a part (K1, K2, K5)."""
    spark = df.sparkSession
    staged, old = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs, to = _fs(spark, path)
    if fs.exists(to(path)):
        fs.rename(to(path), to(old))
    if not fs.rename(to(staged), to(path)):
        if fs.exists(to(old)):
            fs.rename(to(old), to(path))
        raise OSError(f"{staged} can't become {path}")
    fs.delete(to(old), True)


def append_rows(df: DataFrame, path: str) -> None:
    """Incremental insert (K3)."""
    df.write.mode("append").parquet(path)


def delete_keys(spark: SparkSession, path: str, keys: DataFrame, key: str) -> None:
    """Rewrite a table without the given keys (K3)."""
    replace_table(spark.read.parquet(path).join(keys.select(key).distinct(), key, "left_anti"), path)


def write_deliverables(df: DataFrame, folder: str, formats: tuple[str, ...] = ("csv", "json")) -> None:
    """One folder a format (K6)."""
    for f in formats:
        df.write.mode("overwrite").option("header", "true").format(f).save(f"{folder}/{f}")


def bump_version(spark: SparkSession, path: str) -> int:
    """The corpus version after a successful sync, one above the last."""
    fs, to = _fs(spark, path)
    last = spark.read.parquet(path).agg({"corpus_version": "max"}).first()[0] if fs.exists(to(path)) else 0
    spark.createDataFrame([((last or 0) + 1,)], "corpus_version long").write.mode("append").parquet(path)
    return (last or 0) + 1


def sync_package(parents: DataFrame, mapping: DataFrame, vectors: DataFrame, folder: str) -> int:
    """Parents and map first, vectors last, then the version: a reader of the vectors finds its parents (K1, M2)."""
    if not parents.limit(1).count() or not vectors.limit(1).count():
        raise ValueError("a package needs parents and children")
    for name, df in (("parents", parents), ("mapping", mapping), ("vectors", vectors)):
        replace_table(df, f"{folder}/{name}")
    return bump_version(parents.sparkSession, f"{folder}/corpus_version")

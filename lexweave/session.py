"""Session helpers shared by every operator: table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for those whose Python path lacks it."""
    sc = spark.sparkContext
    if getattr(sc, "_lexweave_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexweave-")) / "lexweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, Path("lexweave") / p.relative_to(package))
    sc.addPyFile(str(target))
    sc._lexweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder; filters and columns are pushed to its scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_BYTES = 10_000_000_000  # a larger table is never dealt out: its scan has partitions enough, or maxPartitionBytes is to be set


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """A small scan that has fewer partitions than the cluster has cores, dealt out to all of them.

    Small files with long texts come as one or two partitions, and what reads the texts would run on as many cores. A
    scan of enough partitions, or of more than ``most`` bytes by the optimiser's estimate, is left as it is, so no
    large table is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df if int(str(size)) > most else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one is made only where the setting is absent."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"lexweave-{uuid.uuid4().hex}"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage, so a costly Python stage is not run again by a second reader, and survives the loss of any
    executor. The files lie under the folder the cluster names, to be cleaned with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lexweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_count(df: DataFrame) -> int:
    """Row count of a plain scan; Parquet answers it from the footers."""
    return df.count()

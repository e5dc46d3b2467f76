"""Session settings that the library's plans assume, and lineage cuts through the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "quarryline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; names in settings use __ for the dots."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, materialised in the folder of spark.checkpoint.dir.

    Where none is set, a local master (whose tasks share the driver's disk) gets a temporary one; a cluster must name one
    that all its machines reach.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where it has fewer partitions than there are cores, as a small file has: for dear work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

"""Session settings the jobs are written for, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution decides from measured sizes: it broadcasts a join side only
# when the shuffled side turned out small, splits skewed join partitions, and
# merges small shuffle partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("logloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name in the shared folder that the cluster names.

    The shared folder is the session's `spark.checkpoint.dir`. Only where that is
    unset and the session is local does the machine's own temporary folder serve.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"logloom-{purpose}-")
    return f"{shared.rstrip('/')}/logloom-{purpose}-{uuid.uuid4().hex}"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it back.

    Its size is then known when a join on it is planned, and what follows does not
    compute it again, also when an executor is lost.
    """
    spark, path, schema = df.sparkSession, scratch_dir(df.sparkSession, purpose), df.schema
    df.write.parquet(f"{path}/table")
    return spark.read.schema(schema).parquet(f"{path}/table")

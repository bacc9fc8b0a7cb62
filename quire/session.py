"""Session settings and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir()
    if there is not None and not isinstance(there, str):  # a Scala Option
        there = there.get() if there.isDefined() else None
    if there:
        return there
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quire-")
    sc.setCheckpointDir(own)
    return own


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Inputs up to this size may be moved to spread them over the cores.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from a few small files whose row groups cannot be split. Never more than SPREAD_BYTES are moved, however many cores there are; larger inputs stay as their files give them."""
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df

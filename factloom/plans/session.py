"""Session settings, table access and durable cuts of a plan."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "factloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session as the tests and the bench use it; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_factloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.parent.is_dir() and root.is_dir():
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="factloom-"), "factloom"), "zip", root.parent, root.name))
    spark.conf.set("spark.sql.maxPlanStringLength", "100000")  # literal tables would fill descriptions of plans
    sc._factloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; only where it is unset take a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="factloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: a cut that keeps columns apart and packed, for what is read in parts."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in three partitions a core, where a scan of few files would leave cores idle under costly functions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores, *keys)

"""Session helpers shared by every operator: table access, lineage cuts, size checks."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Largest table that may be broadcast by name. Larger sides go through a shuffle join.
BROADCAST_BYTES = 32 << 20


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine expects (UTC, adaptive plans, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("placeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) is a folder of its own set, below the warehouse
    folder; elsewhere its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/placeloom-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, re.sub("^file:/*", "/", found), ignore_errors=True)
    return found


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the query that wrote them has ended, not when the driver next collects its
    garbage. For tables that are built and used up within it only: a second use would have to make its files again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends, nothing is recomputed
    and the copy outlives any executor. Returns the table and its path for :func:`discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize` that no plan needs any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan (for a scan: its files times the schema's width)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only when the estimated size is under ``limit``; else the plain table."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) <= limit else df

"""Spark session defaults shared by jobs and tests."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Sizes are left to the cluster; AQE picks
# the shuffle width at run time from the initial partition count.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Call sites of Python column expressions are for debugging only.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "tidewarden", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the engine's defaults; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    The setting comes from the session. Only in local mode, where driver and
    executors are one process, may it be unset; a temporary folder stands in for
    it there. On a cluster a machine's own folder would lose rows, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"tidewarden-{name}-")
    return os.path.join(root, f"{name}-{os.urandom(8).hex()}")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there.

    For narrow results that a plan needs in several places: it is computed once, whatever the plan, and what a lost
    executor held is read again.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


CLUSTER_PARTITIONS = 4096


def build_session(master: str | None = None, app: str = "riskloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on and UTC time.

    On a cluster shuffles start with many partitions and are coalesced at run time, so
    the same setting serves small and large inputs; raise ``CLUSTER_PARTITIONS`` where a
    shuffle exceeds some hundred gigabytes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if not (master or "").startswith("local"):
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(CLUSTER_PARTITIONS)
    settings |= conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder all executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local session may do
    without it; it then gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

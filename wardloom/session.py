"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "wardloom", master: str | None = None, **conf: str) -> SparkSession:
    """Start a session with adaptive execution on and UTC time; nothing else is assumed of the cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and the master is one machine, a temporary folder is taken, once per session.
    On a cluster without the setting an error is raised: a local folder would be another one on each executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (spark.conf.get("spark.master", "") or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        configured = tempfile.mkdtemp(prefix="wardloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

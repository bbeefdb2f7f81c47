"""Session settings and the folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings the operators rely on. Calendar parts of zoned timestamps and
#: microsecond arithmetic are only well defined with a pinned zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Settings that only a new session can take. Capturing the caller's source line
#: for every column expression takes longer than planning the query.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def session(name: str = "sensor analytics", **options: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Cluster, memory and parallelism come from ``spark-submit`` or ``options``.
    """
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else built."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the session names.

    A cluster has to name a shared folder in ``spark.checkpoint.dir``. Only a
    local session, whose executors share this machine's disk, may fall back to a
    folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="sondeflow-checkpoints-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()

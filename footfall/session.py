"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results; each can be set on a live session.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key keeps the last value, as browsers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that only change speed.
SPEED_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffled JSON is compressed well and costs much CPU a byte, so small exchanges still feed every core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}

# Speed settings that only a new session can take.
STARTUP_SETTINGS = {
    # Recording a Python call site for every column costs more than small queries take.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that an existing session can take."""
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def get_spark(app: str = "footfall", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a configured session."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS, **STARTUP_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    session, where driver and executors are one machine, may fall back to a temporary
    folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="footfall-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

"""Session defaults: UTC, adaptive execution, RocksDB state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "tidewater", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=DEFAULTS | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under ``spark.checkpoint.dir``; a temporary one where that is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"

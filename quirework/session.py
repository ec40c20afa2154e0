"""A session with the settings that the engine expects, and the folder that all its machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName("quirework").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine, as in tests, it may be unset, and is a temporary folder then."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="quirework-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")

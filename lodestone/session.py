"""The session: configuration by name with defaults, and connecting with retries."""

from __future__ import annotations

import logging
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("lodestone")

#: Attempts, and seconds between them.
RETRIES, WAIT = 12, 5


def setting(name: str, default: str, spark: SparkSession | None = None) -> str:
    """``lodestone.<name>`` of the session, else ``LODESTONE_<NAME>`` of the environment, else the default."""
    found = spark.conf.get(f"lodestone.{name}", None) if spark else None
    return found or os.getenv("LODESTONE_" + name.upper().replace(".", "_"), default)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local run gets a folder of this machine; on
    a cluster executors would each write to their own disk, so that it must be
    named there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def connect(retries: int = RETRIES, wait: float = WAIT, start: Callable[[], SparkSession] | None = None) -> SparkSession:
    """A session that answers; RuntimeError after ``retries`` attempts."""
    start = start or SparkSession.builder.appName("lodestone").getOrCreate
    for attempt in range(1, retries + 1):
        try:
            spark = start()
            if spark.range(1).count() == 1:
                log.info("connected")
                return spark
        except Exception as e:
            log.debug("attempt %d: %s", attempt, e)
        if attempt < retries:
            log.warning("Spark does not answer yet (%d of %d tries left); waiting %s s", retries - attempt, retries, wait)
            time.sleep(wait)
    raise RuntimeError(f"no Spark session after {retries} attempts")

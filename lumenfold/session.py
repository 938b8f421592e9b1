"""Spark sessions with the settings that the operators expect."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, under ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where neither is set, a local master (tests, a laptop) gets a folder of this machine, which goes
    when the process ends; on a cluster that would lose data, so it raises.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"file://{_own_folder()}"
    return f"{base.rstrip('/')}/lumenfold/{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="lumenfold-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def create_session(app: str = "lumenfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` (dots as underscores twice) overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()

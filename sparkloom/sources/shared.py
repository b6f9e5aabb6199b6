"""Paths in the folder that driver and executors share, and tables that are built once and kept there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_KEPT: dict[tuple[str, str, str], str] = {}
#: Bytes that a Python worker is handed at a time, whatever the length of rows.
ARROW_BYTES = 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch: long rows then come in small numbers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"\d+", spark.conf.get(name))
    if not held or not 0 < int(held[0]) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared folder; a local one only where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/sparkloom-shared"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def kept(spark: SparkSession, tag: str, source: str, build: Callable[[str], None]) -> str:
    """The path of what ``build(path)`` made of ``source``: built at first use, then kept for the application.

    For tables that don't change; after a change of the source ``forget`` it.
    """
    key = (spark.sparkContext.applicationId, tag, source)
    if key not in _KEPT:
        path = new_path(spark, tag)
        build(path)
        _KEPT[key] = path
    return _KEPT[key]


def forget(spark: SparkSession, tag: str, source: str) -> None:
    """Delete what ``kept`` holds of ``source``."""
    path = _KEPT.pop((spark.sparkContext.applicationId, tag, source), None)
    if path:
        drop(spark, path)

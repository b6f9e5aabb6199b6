"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back: losing an executor then costs a re-read, never a re-computation of the
whole chain, and the reread table gives Spark exact sizes for its join choice.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

Write = Callable[[DataFrame, str], DataFrame]
#: Bytes that a Python worker is handed at a time, whatever the length of texts.
ARROW_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured and all runs on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.gettempdir()}/sparkloom-shared"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch: rows of long texts then come in small numbers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"\d+", spark.conf.get(name))
    if not held or not 0 < int(held[0]) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def new_path(spark: SparkSession, tag: str) -> str:
    bound_batches(spark)
    return f"{shared_dir(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table under ``path``, reread."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table, which stays."""
    return written(df, new_path(df.sparkSession, tag))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Write]:
    """A ``materialize`` whose tables go with the block: what is needed after it must be written otherwise before."""
    paths: list[str] = []

    def write(df: DataFrame, tag: str) -> DataFrame:
        paths.append(new_path(spark, tag))
        return written(df, paths[-1])

    try:
        yield write
    finally:
        for path in paths:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

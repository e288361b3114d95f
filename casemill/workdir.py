"""Where intermediate tables go: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _scratch() -> str:
    """A folder for a local master without the setting: one for the process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="casemill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _scratch()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/casemill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing ``df`` as Parquet to the shared folder and reading it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

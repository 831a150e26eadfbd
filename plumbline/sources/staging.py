"""Staged tables: results that several later scans read.

A staged table is a Parquet table in the folder that ``spark.checkpoint.dir`` names,
so it outlives lost executors, cuts the lineage and lets later scans read only the
columns they need.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def staging_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


_made: list[str] = []


def staged_path(spark: SparkSession, name: str) -> str:
    folder = f"{staging_folder(spark)}/plumbline-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def drop_staged_tables(spark: SparkSession) -> None:
    """Deletes every table staged so far in this process. Results that still read one are lost, so call it
    when they are written."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged_table(spark: SparkSession, path: str) -> None:
    """Deletes one staged table that nothing reads any more, such as the state of a loop's last round."""
    folder = path.rsplit("/", 1)[0]
    if folder in _made:
        _made.remove(folder)
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the staging folder and returns a scan of it."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

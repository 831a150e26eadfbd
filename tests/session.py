from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session() -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plumbline-")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

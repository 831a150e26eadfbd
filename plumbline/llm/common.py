"""Helpers that several operators share."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.staging import staged, staged_path

__all__ = ["BLANKS", "NOT_BLANK", "by_value", "collapsed", "column_or_null", "drop_staged", "let", "map_batches", "packed", "release", "split_collapsed", "split_words",
           "staged", "staged_path", "whole_row", "word_count"]

# ASCII white space, and a run of anything else: what the operators call a word.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ships a module's functions inside the tasks, so that executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``value`` for use in ``body``. The value is computed once a row, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapsed(text: Column) -> Column:
    """The words of a text without nulls, one space between them."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def split_collapsed(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def split_words(text: Column) -> Column:
    """The words of a text without nulls, as an array; an empty array where there is none."""
    return let(collapsed(text), split_collapsed)


def word_count(text: Column) -> Column:
    return F.size(split_words(F.coalesce(text, F.lit("")))).cast("long")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column that an input may lack."""
    return df[name] if name in df.columns else F.lit(None).cast(kind)


def whole_row(df: DataFrame) -> Column:
    """All columns of a table as the struct ``row``; ``row.*`` gives them back."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("row")


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 256) -> DataFrame:
    """Applies a function to slices of Arrow batches; a worker's memory follows the slice. Rows stay in their partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield function(batch.slice(at, rows))
    return df.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now instead of at the JVM's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def packed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``staged``, in the smallest form, with the path for ``drop_staged``."""
    path = staged_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_staged(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that no later step reads, and the shuffle files of the steps before."""
    for path in paths:
        _delete(spark, path)
    release(spark)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


by_value(__name__)

"""Labels of low-cardinality text columns: case variants and shared prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.text import stripped
from plumbline.operators.columns import STRING, Metric, TableColumn, column_metrics, literal_table, table_columns
from plumbline.operators.frequencies import value_counts

# Columns with up to 100 distinct values are looked at. A HyperLogLog count with 512
# registers can't exceed 112 for them: 100 values fill at most 100 registers, and the
# count is -512 ln(empty share). A larger estimate therefore proves more than 100.
LABEL_LIMIT = 100
ESTIMATE_LIMIT = 120

LABEL_METRICS = [
    Metric("label_estimate", "bigint", (STRING,), lambda c: F.approx_count_distinct(F.lower(c), 0.05), "text"),
]


def label_columns(df: DataFrame, stats: DataFrame | None = None) -> list[TableColumn]:
    """The text columns that may have up to ``LABEL_LIMIT`` labels."""
    strings = table_columns(df, STRING)
    if not strings:
        return []
    stats = column_metrics(df, LABEL_METRICS, strings) if stats is None else stats
    few = {r.column for r in stats.where(F.col("label_estimate") <= ESTIMATE_LIMIT).select("column").collect()}
    return [c for c in strings if c.name in few]


def label_stats(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per low-cardinality text column: n_values, n_stripped, n_labels, noisy_labels.

    ``n_labels`` ignores case and padding. A label is noisy if another of at least two
    characters starts with the same two; of each such group one is taken as right.
    """
    columns = label_columns(df, stats)
    if not columns:
        return literal_table(df.sparkSession, [], "column string, n_values bigint, n_stripped bigint, "
                             "n_labels bigint, noisy_labels bigint, noisy_example string")
    counted = value_counts(df, columns)
    values = (counted.select("column", stripped(F.col("value")).alias("stripped"))
              .groupBy("column", "stripped").agg(F.count(F.lit(1)).alias("values")))
    labels = (values.groupBy("column", F.lower("stripped").alias("label"))
              .agg(F.sum("values").alias("values"), F.count(F.lit(1)).alias("spellings")))
    prefix = F.when(F.length("label") >= 2, F.substring("label", 1, 2))
    groups = labels.groupBy("column", prefix.alias("prefix")).agg(
        F.sum("values").alias("values"), F.sum("spellings").alias("spellings"),
        F.count(F.lit(1)).alias("labels"), F.min("label").alias("first"), F.max("label").alias("last"))
    shared = F.col("prefix").isNotNull() & (F.col("labels") > 1)
    return groups.groupBy("column").agg(
        F.sum("values").alias("n_values"), F.sum("spellings").alias("n_stripped"),
        F.sum("labels").alias("n_labels"),
        F.sum(F.when(shared, F.col("labels") - 1).otherwise(0)).alias("noisy_labels"),
        F.min(F.when(shared, F.concat_ws(" ~ ", "first", "last"))).alias("noisy_example"))

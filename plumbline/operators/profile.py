"""Table profile: shape, null cells, size, first and last rows, column details, description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.columns import (
    ALL_KINDS, BOOLEAN, DATETIME, NUMBER, OTHER, STRING, Metric, TableColumn, blocks, column_metrics, column_names,
    column_ref, literal_table, normalise, table_columns,
)
from plumbline.operators.frequencies import distinct_counts, modes
from plumbline.operators.quantiles import exact_quantiles

WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
          "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
NULL_METRICS = [Metric("nulls", "bigint", ALL_KINDS, lambda c: F.count_if(c.isNull()))]


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def null_cells(df: DataFrame) -> DataFrame:
    """One row: null_cells and cells of the whole table."""
    return column_metrics(df, NULL_METRICS).agg(F.sum("nulls").alias("null_cells"), F.sum("n_rows").alias("cells"))


def size_estimate(df: DataFrame) -> DataFrame:
    """(column, bytes): text by its bytes, other types by their width times the rows."""
    metrics = [Metric("text_bytes", "bigint", (STRING,), lambda c: F.sum(F.octet_length(c))),
               Metric("nested_bytes", "bigint", (OTHER,), lambda c: F.sum(F.octet_length(c)))]
    width = F.create_map(*[x for name, n in WIDTHS.items() for x in (F.lit(name), F.lit(n))])
    fixed = F.coalesce(width[F.col("dtype")], F.lit(16)) * F.col("n_rows")
    return column_metrics(df, metrics).select(
        "position", "column",
        F.when(F.col("kind").isin(STRING, OTHER), F.coalesce("text_bytes", "nested_bytes", F.lit(0)))
        .otherwise(fixed).cast("bigint").alias("bytes"))


def first_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def last_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order_by]).limit(n)


def sample_values(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(column, sample): the first non-null value as text in the order of ``order_by``.

    Without an order it is any value. One aggregate per column and no grouping, since
    text in a grouped aggregate would force a sort.
    """
    def pick(c: TableColumn) -> Column:
        text = c.ref.cast("string")
        return F.any_value(text, True) if order_by is None else F.min_by(text, F.when(c.ref.isNotNull(), column_ref(order_by)))

    parts = []
    for block in blocks(table_columns(df), 100):
        row = df.agg(*[pick(c).alias(c.slot) for c in block])
        parts.append(row.unpivot([], [c.slot for c in block], "slot", "sample"))
    names = F.broadcast(column_names(df.sparkSession, table_columns(df)).select("slot", "column"))
    return reduce(DataFrame.unionByName, parts).join(names, "slot").select("column", "sample")


def column_details(df: DataFrame, order_by: str | None = None, approx: bool = False) -> DataFrame:
    """Per column: dtype, non-null cells, null share, distinct values and a sample value.

    The sample is the first non-null value in the order of ``order_by`` (any, if not given).
    """
    df = normalise(df)
    stats = column_metrics(df, NULL_METRICS).join(sample_values(df, order_by), "column")
    distinct = distinct_counts(df, approx=approx).select("position", "n_distinct")
    return stats.join(distinct, "position", "left").select(
        "position", "column", "dtype", "kind", "n_rows", (F.col("n_rows") - F.col("nulls")).alias("non_null"),
        F.round(F.try_divide(F.col("nulls") * 100.0, F.col("n_rows")), 2).alias("null_pct"),
        "n_distinct", "sample")


DESCRIBE_METRICS = [
    Metric("cells", "bigint", ALL_KINDS, F.count),
    Metric("mean", "double", (NUMBER,), F.avg),
    Metric("std", "double", (NUMBER,), F.stddev_samp),
    Metric("min", "double", (NUMBER,), F.min),
    Metric("max", "double", (NUMBER,), F.max),
    Metric("ts_min", "timestamp", (DATETIME,), F.min),
    Metric("ts_max", "timestamp", (DATETIME,), F.max),
    Metric("ts_mean", "timestamp", (DATETIME,),
           lambda c: F.timestamp_micros(F.try_divide(
               F.sum(F.unix_micros(c).cast("decimal(38,0)")), F.count(c)).cast("bigint"))),
]


def describe(df: DataFrame) -> DataFrame:
    """Per column: count; unique, top, freq of text; mean, std, min, quartiles, max of numbers.

    Timestamps have the same figures in the ``ts_`` columns.
    """
    df = normalise(df)
    stats = column_metrics(df, DESCRIBE_METRICS)
    classes = table_columns(df, STRING, BOOLEAN)
    ranged = table_columns(df, NUMBER, DATETIME)
    found = exact_quantiles(df, ranged, [0.25, 0.5, 0.75]) if ranged else {}
    rows = []
    for c in ranged:
        values = found[c.name]
        rows.append((c.name, *(values + [None] * 3 if c.kind == NUMBER else [None] * 3 + values)))
    quantiles = literal_table(df.sparkSession, rows, "column string, q25 double, q50 double, q75 double, "
                              "u25 double, u50 double, u75 double")
    result = stats.join(quantiles, "column", "left")
    if classes:
        result = result.join(modes(df, classes).withColumnsRenamed(
            {"n_distinct": "unique", "mode": "top", "n": "freq"}), "column", "left")
    else:
        result = result.withColumns({"unique": F.lit(None).cast("bigint"), "top": F.lit(None).cast("string"),
                                     "freq": F.lit(None).cast("bigint")})
    times = [F.timestamp_micros(F.col(f"u{q}").cast("bigint")).alias(f"ts_q{q}") for q in (25, 50, 75)]
    return result.select("position", "column", F.col("cells").alias("count"), "unique", "top", "freq",
                         "mean", "std", "min", "q25", "q50", "q75", "max",
                         "ts_mean", "ts_min", *times, "ts_max")

"""Completeness: null, placeholder, empty and blank cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.numeric import clamp
from plumbline.functions.text import is_blank, is_empty, is_placeholder
from plumbline.operators.columns import ALL_KINDS, STRING, Metric, column_metrics, count_cells
from plumbline.rules import RuleProfile


def missing_metrics(profile: RuleProfile) -> list[Metric]:
    return [
        Metric("nulls", "bigint", ALL_KINDS, lambda c: F.count_if(c.isNull())),
        Metric("placeholders", "bigint", (STRING,),
               count_cells(lambda c: is_placeholder(c, profile.placeholders)), "text"),
        Metric("blanks", "bigint", (STRING,), count_cells(is_blank), "text"),
        Metric("empties", "bigint", (STRING,), count_cells(is_empty)),
    ]


def missing_by_column(df: DataFrame, profile: RuleProfile, stats: DataFrame | None = None) -> DataFrame:
    """Per column: nulls, empty, whitespace-only and placeholder cells and their share.

    ``severity`` looks at real nulls only: critical above 40 %, moderate above 5 %.
    """
    stats = column_metrics(df, missing_metrics(profile)) if stats is None else stats
    zero = F.lit(0).cast("bigint")
    blanks, empties = F.coalesce("blanks", zero), F.coalesce("empties", zero)
    holders = F.coalesce("placeholders", zero)
    missing = F.col("nulls") + blanks + holders
    null_pct = F.round(F.try_divide(F.col("nulls") * 100.0, F.col("n_rows")), 1)
    return stats.select(
        "position", "column", "n_rows", "nulls", empties.alias("empty_cells"),
        (blanks - empties).alias("whitespace_cells"), holders.alias("placeholder_cells"),
        missing.alias("missing_cells"), null_pct.alias("null_pct"),
        F.round(F.try_divide(missing * 100.0, F.col("n_rows")), 2).alias("missing_pct"),
        F.when(null_pct > 40, "critical").when(null_pct > 5, "moderate").alias("severity"))


def missing_totals(by_column: DataFrame) -> DataFrame:
    """One row over the whole table, with the missing rate as a fraction."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    summed = by_column.agg(
        total("nulls"), total("empty_cells"), total("whitespace_cells"), total("placeholder_cells"),
        total("missing_cells"), F.sum("n_rows").alias("cells"),
        F.count_if(F.col("missing_cells") > 0).alias("columns_affected"),
        F.count_if(F.col("nulls") == F.col("n_rows")).alias("empty_columns"),
        F.count_if(F.col("severity") == "critical").alias("critical_columns"),
        F.count_if(F.col("severity") == "moderate").alias("moderate_columns"))
    return summed.withColumn("missing_rate", F.try_divide(F.col("missing_cells").cast("double"), F.col("cells")))


def completeness_score(rate: Column, profile: RuleProfile) -> Column:
    """The audit profile falls in tiers, with jumps at 1, 5 and 20 %; the other is linear."""
    if profile.name == "universal":
        return clamp(100.0 - 150.0 * rate, low=0)
    return (F.when(rate == 0, F.lit(100.0))
            .when(rate < 0.01, F.lit(98.0))
            .when(rate < 0.05, 90.0 - 200.0 * rate)
            .when(rate < 0.20, 80.0 - 150.0 * rate)
            .otherwise(clamp(50.0 - 100.0 * rate, low=0)))

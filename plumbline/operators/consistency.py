"""Consistency of text columns: mixed types, case, date formats, encoding damage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.numeric import clamp
from plumbline.functions.text import is_garbled, is_number_text, matches_date_pattern, starts_with_letter
from plumbline.operators.columns import (
    STRING, Metric, column_metrics, count_cells, merge_metrics, table_columns,
)
from plumbline.operators.labels import LABEL_METRICS, label_stats
from plumbline.rules import RuleProfile

MIXED_TYPE_METRICS = [
    Metric("present", "bigint", (STRING,), F.count),
    Metric("numeric_like", "bigint", (STRING,), count_cells(is_number_text), "text"),
    Metric("letter_first", "bigint", (STRING,), count_cells(starts_with_letter)),
]


def _pattern_test(pattern: str, profile: RuleProfile):
    return lambda c: matches_date_pattern(c, pattern, profile.date_anchored)


def date_format_metrics(profile: RuleProfile) -> list[Metric]:
    return [Metric(f"date_pattern_{i}", "bigint", (STRING,), count_cells(_pattern_test(p, profile)))
            for i, p in enumerate(profile.date_patterns)]


def garbled_metrics(profile: RuleProfile) -> list[Metric]:
    return [Metric("garbled", "bigint", (STRING,),
                   count_cells(lambda c: is_garbled(c, profile.flags_any_non_ascii)))]


def consistency_metrics(profile: RuleProfile) -> list[Metric]:
    return merge_metrics(MIXED_TYPE_METRICS, date_format_metrics(profile), garbled_metrics(profile), LABEL_METRICS)


def _strings(df: DataFrame, stats: DataFrame | None, metrics: list[Metric]) -> DataFrame:
    if stats is not None:
        return stats.where(F.col("kind") == STRING)
    return column_metrics(df, metrics, table_columns(df, STRING))


def mixed_types(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Text columns that hold numbers in part and at least one value that starts with a letter."""
    stats = _strings(df, stats, MIXED_TYPE_METRICS)
    return stats.where((F.col("numeric_like") > 0) & (F.col("numeric_like") < F.col("present"))
                       & (F.col("letter_first") > 0)
                       ).select("column", "numeric_like", "letter_first", "present")


def case_issues(df: DataFrame, profile: RuleProfile, labels: DataFrame | None = None) -> DataFrame:
    """Columns with few values in which some labels differ in case only."""
    labels = label_stats(df) if labels is None else labels
    return labels.where((F.col("n_values") <= profile.case_max_distinct)
                        & (F.col("n_labels") < F.col("n_stripped"))
                        ).select("column", "n_stripped", "n_labels",
                                 (F.col("n_stripped") - F.col("n_labels")).alias("extra_labels"))


def date_format_mix(df: DataFrame, profile: RuleProfile, stats: DataFrame | None = None,
                    labels: DataFrame | None = None) -> DataFrame:
    """Columns whose values follow more than one date pattern."""
    stats = _strings(df, stats, merge_metrics(date_format_metrics(profile), LABEL_METRICS))
    hits = [F.when(F.col(f"date_pattern_{i}") >= profile.date_min_hits, 1).otherwise(0)
            for i in range(len(profile.date_patterns))]
    found = sum(hits[1:], hits[0])
    mixed = stats.select("column", found.cast("bigint").alias("formats_found")).where(F.col("formats_found") > 1)
    if not profile.date_min_distinct:
        return mixed
    # A column missing from the label table has more than 100 values.
    labels = label_stats(df) if labels is None else labels
    few = labels.where(F.col("n_values") < profile.date_min_distinct).select("column")
    return mixed.join(few, "column", "left_anti")


def garbled_text(df: DataFrame, profile: RuleProfile, stats: DataFrame | None = None) -> DataFrame:
    """Columns with encoding damage and the number of cells affected."""
    stats = _strings(df, stats, garbled_metrics(profile))
    return stats.where(F.col("garbled") > 0).select("column", F.col("garbled").alias("affected_rows"))


ISSUES = ("mixed_type", "date_format", "case", "encoding")


def consistency_issues(df: DataFrame, profile: RuleProfile, stats: DataFrame | None = None,
                       labels: DataFrame | None = None) -> DataFrame:
    """(issue, column, n): one row per column and issue; a column can have up to four."""
    labels = label_stats(df, stats) if labels is None else labels
    found = {
        "mixed_type": mixed_types(df, stats).select("column", F.col("numeric_like").alias("n")),
        "date_format": date_format_mix(df, profile, stats, labels).select("column", F.col("formats_found").alias("n")),
        "case": case_issues(df, profile, labels).select("column", F.col("extra_labels").alias("n")),
        "encoding": garbled_text(df, profile, stats).select("column", F.col("affected_rows").alias("n")),
    }
    return reduce(DataFrame.unionByName,
                  [part.select(F.lit(issue).alias("issue"), "column", F.col("n").cast("bigint").alias("n"))
                   for issue, part in found.items()])


def consistency_score(issues: Column, n_columns: int, profile: RuleProfile) -> Column:
    return clamp(100.0 - profile.consistency_penalty * issues / float(n_columns), low=0)

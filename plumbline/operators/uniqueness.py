"""Uniqueness: constant columns and the scores from duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.numeric import clamp
from plumbline.operators.columns import (
    ALL_KINDS, BOOLEAN, DATETIME, NUMBER, OTHER, STRING, Metric, column_metrics, merge_metrics,
)
from plumbline.operators.labels import LABEL_METRICS, label_stats
from plumbline.rules import RuleProfile

CONSTANT_METRICS = [
    Metric("nulls", "bigint", ALL_KINDS, lambda c: F.count_if(c.isNull())),
    Metric("varies", "boolean", (NUMBER, BOOLEAN, DATETIME), lambda c: F.min(c) < F.max(c)),
    Metric("varies_nested", "boolean", (OTHER,), lambda c: F.min(F.xxhash64(c)) < F.max(F.xxhash64(c))),
]


def constant_columns(df: DataFrame, stats: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Columns with at most one distinct value, columns of nulls included.

    The ends of the range settle most types; text columns are settled by their exact
    labels, which only columns with few values have.
    """
    if stats is None:
        stats = column_metrics(df, merge_metrics(CONSTANT_METRICS, LABEL_METRICS))
    labels = label_stats(df, stats) if labels is None else labels
    same = F.when(F.col("kind") == STRING, F.col("n_values") <= 1).otherwise(~F.coalesce("varies", "varies_nested"))
    joined = stats.join(labels.select("column", "n_values"), "column", "left")
    return joined.where((F.col("nulls") == F.col("n_rows")) | same).select("position", "column")


def uniqueness_score_audit(duplicate_rate: Column, constants: Column, pairs: Column) -> Column:
    rows = clamp(150.0 * duplicate_rate, high=60)
    columns = clamp(5.0 * constants + 8.0 * pairs, high=30)
    return clamp(100.0 - rows - columns, low=0)


def uniqueness_score_universal(duplicate_rate: Column, near_rate: Column) -> Column:
    return clamp(100.0 - 200.0 * (duplicate_rate + 0.3 * near_rate), low=0)


def uniqueness_score(facts: dict[str, Column], profile: RuleProfile) -> Column:
    if profile.name == "universal":
        return uniqueness_score_universal(facts["duplicate_rate"], facts["near_rate"])
    return uniqueness_score_audit(facts["duplicate_rate"], facts["constant_columns"], facts["identical_pairs"])

"""Accuracy proxies: skewed numbers, noisy labels, dominant classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.numeric import clamp, sample_skewness
from plumbline.operators.columns import NUMBER, STRING, Metric, column_metrics, literal_table, table_columns
from plumbline.operators.frequencies import distinct_counts, modes
from plumbline.rules import RuleProfile

DOMINANT_SHARE = 0.85

SKEW_METRICS = [
    Metric("number_cells", "bigint", (NUMBER,), F.count),
    Metric("skewness", "double", (NUMBER,), sample_skewness),
]
# A value held by more than 85 % of the cells is the median of any ordering, and a
# median that is off by 1 % still is. So one small sketch of the hashes finds it.
# Hashes are cut to 52 bits, which the sketch keeps exactly as doubles.
DOMINANT_METRICS = [
    Metric("middle_hash", "bigint", (STRING,), lambda c: F.percentile_approx(_short_hash(c), 0.5, 100)),
]


def _short_hash(c: Column) -> Column:
    return F.when(c.isNotNull(), F.shiftright(F.xxhash64(c), 12))


def skewed_columns(df: DataFrame, profile: RuleProfile, stats: DataFrame | None = None) -> DataFrame:
    """(column, skewness, severity) for number columns beyond the profile's limit."""
    if stats is None:
        stats = column_metrics(df, SKEW_METRICS, table_columns(df, NUMBER))
    size = F.abs("skewness")
    return stats.where((F.col("number_cells") >= profile.skew_min_count) & (size > profile.skew_limit)).select(
        "column", "skewness", F.when(size > 5, "extreme").otherwise("high").alias("severity"))


def imbalanced_columns(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(column, dominant_class, dominant_pct, n_classes): one value above 85 % of the cells."""
    strings = table_columns(df, STRING)
    schema = "column string, dominant_class string, dominant_pct double, n_classes bigint"
    if not strings:
        return literal_table(df.sparkSession, [], schema)
    stats = column_metrics(df, DOMINANT_METRICS, strings) if stats is None else stats
    middle = {r.column: r.middle_hash for r in stats.where(F.col("middle_hash").isNotNull())
              .select("column", "middle_hash").collect()}
    candidates = [c for c in strings if c.name in middle]
    if not candidates:
        return literal_table(df.sparkSession, [], schema)
    aggregates = []
    for c in candidates:
        middle_value = F.when(_short_hash(c.ref) == F.lit(middle[c.name]), c.ref)
        aggregates += [F.count(c.ref).alias(f"n_{c.slot}"), F.count(middle_value).alias(f"k_{c.slot}"),
                       F.min(middle_value).alias(f"low_{c.slot}"), F.max(middle_value).alias(f"high_{c.slot}")]
    row = df.agg(*aggregates).first()
    dominant = []
    for c in candidates:
        n, k, value = row[f"n_{c.slot}"], row[f"k_{c.slot}"], row[f"low_{c.slot}"]
        if k > DOMINANT_SHARE * n and value != row[f"high_{c.slot}"]:
            # Two values share the hash: count them one by one.
            exact = modes(df, [c]).first()
            k, value = exact.n, exact["mode"]
        if DOMINANT_SHARE * n < k < n:
            dominant.append((c.name, value, 100.0 * k / n))
    if not dominant:
        return literal_table(df.sparkSession, [], schema)
    names = [name for name, _, _ in dominant]
    classes = distinct_counts(df, table_columns(df, STRING, names=names)).select(
        "column", F.col("n_distinct").alias("n_classes"))
    found = literal_table(df.sparkSession, dominant,
                          "column string, dominant_class string, dominant_pct double")
    return found.join(classes, "column").select("column", "dominant_class", "dominant_pct", "n_classes")


def noisy_labels(labels: DataFrame) -> DataFrame:
    """(column, n_labels, noisy_labels, example) for columns with 2 to 30 labels."""
    return labels.where(F.col("n_labels").between(2, 30) & (F.col("noisy_labels") > 0)).select(
        "column", "n_labels", "noisy_labels", "noisy_example")


def skew_penalty(skewness: Column) -> Column:
    return F.least(F.abs(skewness) / 20.0, F.lit(0.05))


def accuracy_score_audit(skewed: Column, noisy: Column) -> Column:
    return clamp(100.0 - clamp(4.0 * skewed, high=30) - clamp(8.0 * noisy, high=40), low=0)


def accuracy_score_universal(penalty: Column, imbalanced: Column, text_columns: int) -> Column:
    return clamp(100.0 - 100.0 * penalty - 20.0 * imbalanced / float(max(1, text_columns)), low=0)

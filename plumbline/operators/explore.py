"""Distributions, outlier inspection, relations and target analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline import rules
from plumbline.functions.numeric import pearson, sample_kurtosis, sample_skewness
from plumbline.operators.classify import by_role
from plumbline.operators.columns import (
    BOOLEAN, NUMBER, STRING, Metric, TableColumn, cells, column_metrics, column_ref, literal_table, blocks,
    table_columns,
)
from plumbline.operators.correlation import strength
from plumbline.operators.frequencies import distinct_counts, top_values
from plumbline.operators.quantiles import exact_quantiles, quantile_table
from plumbline.operators.validity import outside, quartiles

MAX_BINS = 50


def _columns(df: DataFrame, names: list[str] | None, *kinds: str) -> list[TableColumn]:
    return table_columns(df, *(kinds or (NUMBER,)), names=names)


def _numeric(df: DataFrame, names: list[str] | None, *kinds: str) -> list[TableColumn]:
    """The named columns; those in the role of a number, without ids and codes, where none are named."""
    return _columns(df, by_role(df, "numeric") if names is None else names, *kinds)


def _bin_counts(df: DataFrame, columns: list[TableColumn], bins: int) -> dict[str, int]:
    """min(bins, distinct values) per column; only columns that may have few are counted."""
    # A HyperLogLog count with m >= 4 * bins registers takes -m ln(empty share) while few are filled. As many
    # values as bins fill a quarter of the registers at most, which gives 1.16 times the bins; a larger
    # estimate proves more values than bins. Beyond 2^16 registers all columns are counted.
    bits = max(9, (4 * bins - 1).bit_length())
    few = columns
    if bits <= 16:
        row = df.agg(*[F.approx_count_distinct(c.ref, 1.105 / 2 ** (bits / 2)).alias(f"c{c.position}") for c in columns]).first()
        few = [c for c in columns if row[f"c{c.position}"] <= 1.16 * bins + 1]
    exact = {r.column: r.n_distinct for r in distinct_counts(df, few).collect()} if few else {}
    return {c.name: min(bins, exact.get(c.name, bins)) for c in columns}


def histogram(df: DataFrame, names: list[str] | None = None, bins: int = MAX_BINS) -> DataFrame:
    """(column, bin, low, high, n): equal-width bins over the finite values, at most one per distinct value.

    The last bin includes its upper end; empty bins have no row. Infinities have bins of their own beside the others: bin 0 and the one after the last.
    """
    columns = _numeric(df, names, NUMBER, BOOLEAN)
    finite = df.withColumns({c.name: F.when(F.abs(c.ref) < float("inf"), c.ref) for c in columns if c.dtype in ("float", "double")})
    n_bins = _bin_counts(finite, columns, bins)
    ends = finite.agg(*[f(c.cell).alias(f"{p}{c.position}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))]).first()
    slots, bounds = [], []
    for c in columns:
        low, high, k = ends[f"lo{c.position}"], ends[f"hi{c.position}"], n_bins[c.name]
        value = c.cell
        if low is None:
            low, high, k, place = 0.0, 0.0, 0, F.lit(None)  # no finite value
        elif low == high:
            place = F.lit(1)  # width_bucket has no answer for a constant column
        else:
            place = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(k)), F.lit(k))
        place = F.when(value == float("-inf"), F.lit(0)).when(value == float("inf"), F.lit(k + 1)).when(value.isNotNull(), place)
        slots.append(place.cast("int").alias(f"c{c.position}"))
        bounds.append((f"c{c.position}", c.name, low, (high - low) / k if k else 0.0, k))
    spans = literal_table(df.sparkSession, bounds, "slot string, column string, start double, width double, bins int")
    counted = (df.select(*slots).unpivot([], [b[0] for b in bounds], "slot", "bin").where(F.col("bin").isNotNull())
               .groupBy("slot", "bin").agg(F.count(F.lit(1)).alias("n")))
    infinite = F.when(F.col("bin") == 0, F.lit(float("-inf"))).when(F.col("bin") > F.col("bins"), F.lit(float("inf")))
    return counted.join(F.broadcast(spans), "slot").select(
        "column", "bin", F.coalesce(infinite, F.col("start") + F.col("width") * (F.col("bin") - 1)).alias("low"),
        F.coalesce(infinite, F.col("start") + F.col("width") * F.col("bin")).alias("high"), "n")


MOMENT_METRICS = [
    Metric("count", "bigint", (NUMBER, BOOLEAN), F.count),
    Metric("mean", "double", (NUMBER, BOOLEAN), F.avg),
    Metric("std", "double", (NUMBER, BOOLEAN), F.stddev_samp),
    Metric("min", "double", (NUMBER, BOOLEAN), F.min),
    Metric("max", "double", (NUMBER, BOOLEAN), F.max),
    Metric("skewness", "double", (NUMBER, BOOLEAN), sample_skewness),
    Metric("kurtosis", "double", (NUMBER, BOOLEAN), sample_kurtosis),
]


def numeric_summary(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per number column: mean, median, std, skewness and the direction of the skew."""
    details = numeric_details(df, names)
    skew = F.round("skewness", 2)
    return details.select("column", "mean", "median", "std", "skewness",
                          F.when(skew > 1, "right").when(skew < -1, "left").otherwise("normal").alias("skew_label"))


def numeric_details(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per number column: count, mean, median, std, min, max, skewness, kurtosis, quartiles."""
    columns = _numeric(df, names)
    middle = quantile_table(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    stats = column_metrics(df, MOMENT_METRICS, columns)
    return stats.join(F.broadcast(middle), "column").select(
        "column", "count", "mean", "median", "std", "min", "max", "skewness", "kurtosis", "q1", "q3")


def box_stats(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per number column: quartiles, the whiskers inside 1.5 quartile ranges, cells beyond."""
    columns = _numeric(df, names)
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = []
    for c in columns:
        q1, median, q3 = found[c.name]
        reach = None if q1 is None else rules.BOX_FENCE * (q3 - q1)
        rows.append((c.slot, c.name, q1, median, q3, *((None, None) if reach is None else (q1 - reach, q3 + reach))))
    table = literal_table(df.sparkSession, rows, "slot string, column string, q1 double, median double, q3 double, "
                          "low double, high double")
    value = F.col("value")
    inside = F.when(value.between(F.col("low"), F.col("high")), value)
    bounds = F.broadcast(table.select("slot", "low", "high"))
    counted = reduce(DataFrame.unionByName, [
        cells(df, block).join(bounds, "slot").groupBy("slot").agg(
            F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
            (F.count("value") - F.count(inside)).alias("outliers"))
        for block in blocks(columns)])
    return counted.join(F.broadcast(table), "slot").select(
        "column", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")


def _box_bounds(df: DataFrame, column: str) -> tuple[float, float] | None:
    q1, q3 = quartiles(df, table_columns(df, NUMBER, names=[column]))[column]
    if q1 is None:
        return None
    return q1 - rules.BOX_FENCE * (q3 - q1), q3 + rules.BOX_FENCE * (q3 - q1)


def outlier_rows(df: DataFrame, column: str, order_by: list[str], limit: int | None = rules.DISPLAY_ROWS) -> DataFrame:
    """Rows beyond 1.5 quartile ranges of one column; the bounds reach the scan as filters."""
    bounds = _box_bounds(df, column)
    found = df.where(outside(column_ref(column), bounds) if bounds else F.lit(False))
    return found.orderBy(*order_by).limit(limit) if limit else found


def outlier_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: bounds, outliers and their share of all rows."""
    bounds = _box_bounds(df, column)
    low, high = bounds or (None, None)
    n = F.count_if(outside(column_ref(column), bounds)) if bounds else F.lit(0).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), n.alias("outliers")).select(
        F.lit(column).alias("column"), F.lit(low).cast("double").alias("lower_bound"),
        F.lit(high).cast("double").alias("upper_bound"), "outliers",
        F.try_divide(F.col("outliers") * 100.0, F.col("n_rows")).alias("outlier_pct"))


def pair_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: r of two columns and how strong it is."""
    r = df.agg(pearson(column_ref(x).cast("double"), column_ref(y).cast("double")).alias("r"))
    return r.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "r", strength(F.col("r")).alias("strength"))


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares line of y on x over the rows with both; null if x is constant."""
    a, b = column_ref(x).cast("double"), column_ref(y).cast("double")
    return df.agg(F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"),
                  F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def category_summary(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per column: the top value, its share of all rows, an imbalance flag, distinct values."""
    columns = _columns(df, names, STRING, NUMBER, BOOLEAN)
    distinct = distinct_counts(df, columns).select("column", "n_distinct")
    return _with_share(df, top_values(df, columns, 1)).join(distinct, "column").select(
        "column", F.col("value").alias("top_value"), F.col("n").alias("top_n"), "pct",
        (F.col("pct") > 80).alias("imbalanced"), "n_distinct")


def _with_share(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Adds the share of all rows, nulls included, in percent with one decimal."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows")).first().n_rows
    return counted.withColumn("pct", F.round(F.col("n") * 100.0 / F.lit(float(max(n, 1))), 1))


def category_values(df: DataFrame, names: list[str] | None = None, k: int = 20) -> DataFrame:
    """(column, rank, value, n, pct): the k most frequent values and their share of all rows."""
    return _with_share(df, top_values(df, _columns(df, names, STRING, NUMBER, BOOLEAN), k))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n) for the non-null classes of a target."""
    return (df.where(column_ref(target).isNotNull()).groupBy(column_ref(target).cast("string").alias("class"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, majority and minority share, imbalance ratio and a verdict."""
    totals = class_counts(df, target).agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("total"),
        F.max("n").alias("largest"), F.min("n").alias("smallest"))
    ratio = F.col("largest") / F.greatest(F.col("smallest"), F.lit(1))
    return totals.select(
        F.lit(target).alias("target"), "n_classes",
        F.try_divide(F.col("largest") * 100.0, F.col("total")).alias("majority_pct"),
        F.try_divide(F.col("smallest") * 100.0, F.col("total")).alias("minority_pct"),
        ratio.alias("imbalance_ratio"),
        F.when(ratio > 10, "severe").when(ratio > 3, "moderate").otherwise("balanced").alias("verdict"))


def regression_target(df: DataFrame, target: str) -> DataFrame:
    """One row: mean, median, std and skewness of a target and whether to take its log."""
    return numeric_details(df, [target]).select(
        F.col("column").alias("target"), "mean", "median", "std", "skewness",
        F.when(F.abs("skewness") > 2, "log transform").otherwise("suitable").alias("advice"))


def distinct_sample(df: DataFrame, column: str, order_by: str, k: int = 30) -> DataFrame:
    """(position, value): the first k distinct non-null values in the order of ``order_by``."""
    first = (df.where(column_ref(column).isNotNull()).groupBy(column_ref(column).alias("value"))
             .agg(F.min(order_by).alias("first_at")))
    return first.orderBy("first_at").limit(k).select("first_at", "value")

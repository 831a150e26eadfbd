"""Validity: extreme outliers, impossible values, future dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import rules
from plumbline.functions.numeric import clamp
from plumbline.functions.text import date_text, parsed_date
from plumbline.operators.columns import (
    DATETIME, NUMBER, STRING, TableColumn, cells, column_names, literal_table, blocks, table_columns,
)
from plumbline.operators.quantiles import exact_quantiles
from plumbline.rules import RuleProfile

OUTLIER_SCHEMA = ("column string, q1 double, q3 double, lower_bound double, upper_bound double, "
                  "present bigint, outliers bigint, min_value double, max_value double")
MIN_CELLS = 4


def quartiles(df: DataFrame, columns: list[TableColumn] | None = None) -> dict[str, tuple[float | None, float | None]]:
    columns = table_columns(df, NUMBER) if columns is None else columns
    return {name: (q[0], q[1]) for name, q in exact_quantiles(df, columns, [0.25, 0.75]).items()} if columns else {}


def fences(q1: float | None, q3: float | None, factor: float) -> tuple[float, float] | None:
    """Bounds at ``factor`` times the quartile range, or None if the range is 0."""
    if q1 is None or q3 is None or not q3 - q1 > 0:
        return None
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def outside(c: Column, bounds: tuple[float, float]) -> Column:
    return (c < F.lit(bounds[0])) | (c > F.lit(bounds[1]))


def outlier_counts(df: DataFrame, factor: float = rules.EXTREME_FENCE) -> DataFrame:
    """Per number column: quartiles, fences, cells outside (0 below four cells), min, max.

    The quartiles come first. Their fences, one row per column, then meet the cells in one
    counting scan.
    """
    columns = table_columns(df, NUMBER)
    if not columns:
        return literal_table(df.sparkSession, [], OUTLIER_SCHEMA)
    found = quartiles(df, columns)
    rows = [(c.slot, c.name, *found[c.name], *(fences(*found[c.name], factor) or (None, None))) for c in columns]
    table = literal_table(df.sparkSession, rows, "slot string, column string, q1 double, q3 double, "
                          "lower_bound double, upper_bound double")
    beyond = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    bounds = F.broadcast(table.select("slot", "lower_bound", "upper_bound"))
    counted = reduce(DataFrame.unionByName, [
        cells(df, block).join(bounds, "slot").groupBy("slot").agg(
            F.count("value").alias("present"), F.count_if(beyond).alias("beyond"),
            F.min("value").alias("min_value"), F.max("value").alias("max_value"))
        for block in blocks(columns)])
    outliers = F.when(F.col("present") >= MIN_CELLS, F.col("beyond")).otherwise(F.lit(0)).cast("bigint")
    return counted.join(F.broadcast(table), "slot").select(
        "column", "q1", "q3", "lower_bound", "upper_bound", "present", outliers.alias("outliers"),
        "min_value", "max_value")


def outlier_columns(counts: DataFrame) -> DataFrame:
    """Columns with outliers, their share of the non-null cells and its severity."""
    pct = F.try_divide(F.col("outliers") * 100.0, F.col("present"))
    return counts.where(F.col("outliers") > 0).select(
        "column", "outliers", pct.alias("outlier_pct"),
        F.when(pct > 5, "high").otherwise("low").alias("severity"),
        "lower_bound", "upper_bound", "min_value", "max_value")


def impossible_values(df: DataFrame, profile: RuleProfile) -> DataFrame:
    """(column, rule, bad_values): cells that break a rule chosen by the column's name.

    A column may match several rules. Columns with fewer than four values are skipped.
    """
    hits = [(c, rule) for c in table_columns(df, NUMBER) for rule in profile.ranges if rule.applies_to(c.name)]
    if not hits:
        return literal_table(df.sparkSession, [], "column string, rule string, bad_values bigint")
    limits = literal_table(df.sparkSession, [(c.slot, c.name, rule.name, rule.low, rule.high) for c, rule in hits],
                           "slot string, column string, rule string, low double, high double")
    columns = list({c.position: c for c, _ in hits}.values())
    broken = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    counted = reduce(DataFrame.unionByName, [
        cells(df, block).join(F.broadcast(limits), "slot").groupBy("column", "rule").agg(
            F.count("value").alias("present"), F.count_if(broken).alias("bad_values"))
        for block in blocks(columns)])
    return counted.where((F.col("present") >= MIN_CELLS) & (F.col("bad_values") > 0)).select(
        "column", "rule", "bad_values")


def future_dates(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """(column, future_dates): cells later than ``as_of`` (default: now).

    A text column is read with the one date layout that most of its cells have.
    """
    limit = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    columns = table_columns(df, STRING, DATETIME)
    if not columns:
        return literal_table(df.sparkSession, [], "column string, future_dates bigint")
    parts = []
    for block in blocks([c for c in columns if c.kind == DATETIME]):
        parts.append(cells(df, block).groupBy("slot").agg(F.count_if(F.col("value") > limit).alias("future_dates")))
    layouts = range(len(rules.DATE_FORMATS))
    for block in blocks([c for c in columns if c.kind == STRING]):
        short = cells(df, block).where(date_text(F.col("value")).isNotNull())
        parsed = short.select("slot", *[
            parsed_date(F.col("value"), *rules.DATE_FORMATS[i]).alias(f"t{i}") for i in layouts])
        counted = parsed.groupBy("slot").agg(
            *[F.count(f"t{i}").alias(f"n{i}") for i in layouts],
            *[F.count_if(F.col(f"t{i}") > limit).alias(f"f{i}") for i in layouts])
        best = F.greatest(*[F.struct(F.col(f"n{i}").alias("parsed"), F.lit(-i).alias("order"),
                                     F.col(f"f{i}").alias("future")) for i in layouts])
        parts.append(counted.select("slot", best["future"].alias("future_dates")))
    names = F.broadcast(column_names(df.sparkSession, columns).select("slot", "column"))
    return (reduce(DataFrame.unionByName, parts).where(F.col("future_dates") > 0)
            .join(names, "slot").select("column", "future_dates"))


def validity_score(totals: dict[str, Column], n_rows: Column, profile: RuleProfile) -> Column:
    rate = totals["outlier_cells"] / F.greatest(totals["number_cells"], F.lit(1))
    if profile.name == "universal":
        bad = F.try_divide(totals["impossible_cells"].cast("double"), n_rows)
        return clamp(100.0 - 60.0 * rate - 100.0 * bad, low=0)
    return clamp(100.0 - 80.0 * rate - clamp(10.0 * totals["rules_hit"], high=40), low=0)

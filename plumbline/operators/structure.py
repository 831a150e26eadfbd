"""Structure: column names, numbers kept as text, empty and uniform rows, table shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.numeric import clamp
from plumbline.functions.text import is_number_text
from plumbline.operators.columns import (
    BOOLEAN, NUMBER, STRING, Metric, TableColumn, column_metrics, count_cells, literal_table, table_columns,
)
from plumbline.rules import RuleProfile

TEXT_NUMBER_SHARE = 0.95
TEXT_NUMBER_METRICS = [Metric("numeric_like", "bigint", (STRING,), count_cells(is_number_text), "text")]


def name_issue(name: str, profile: RuleProfile) -> str | None:
    """What is wrong with a column name: unnamed, blank, spaces or special."""
    special = re.search(r"[^a-zA-Z0-9_ ]", name) is not None
    blank = not name.strip()
    if profile.name == "universal":
        tests = (("blank", blank), ("unnamed", name[:7] in ("Unnamed", "unnamed")),
                 ("spaces", re.search(r"\s{2,}", name) is not None), ("special", special))
    else:
        tests = (("unnamed", name.startswith("Unnamed")), ("blank", blank), ("special", special))
    return next((issue for issue, hit in tests if hit), None)


def bad_names(df: DataFrame, profile: RuleProfile) -> DataFrame:
    """(column, issue); read from the schema alone."""
    rows = [(n, name_issue(n, profile)) for n in df.columns]
    return literal_table(df.sparkSession, [r for r in rows if r[1]], "column string, issue string")


def numbers_as_text(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Text columns of which more than 95 % of all rows read as numbers; nulls count against."""
    if stats is None:
        stats = column_metrics(df, TEXT_NUMBER_METRICS, table_columns(df, STRING))
    share = F.try_divide(F.col("numeric_like").cast("double"), F.col("n_rows"))
    return stats.where(share > TEXT_NUMBER_SHARE).select("column", share.alias("numeric_share"))


def _tagged(c: TableColumn) -> Column:
    """The cell as text such that equal numbers of different types agree."""
    if c.kind in (NUMBER, BOOLEAN):
        number = c.ref.cast("int") if c.kind == BOOLEAN else c.ref
        return F.concat(F.lit("n:"), (number.cast("double") + F.lit(0.0)).cast("string"))
    if c.kind == STRING:
        return F.concat(F.lit("s:"), c.ref)
    return F.concat(F.lit(f"{c.dtype}:"), F.to_json(F.struct(c.ref.alias("v"))))


def row_shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, empty_rows (all null), uniform_rows (one distinct value across the row)."""
    columns = table_columns(df)
    empty = F.lit(True)
    for c in columns:
        empty = empty & c.ref.isNull()
    cells = F.array(*[F.when(c.ref.isNotNull(), _tagged(c)) for c in columns])
    uniform = F.size(F.array_distinct(F.array_compact(cells))) == 1
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(empty).alias("empty_rows"),
                  F.count_if(uniform).alias("uniform_rows"))


def structure_score(issues: Column, rows_per_column: Column, n_columns: int, profile: RuleProfile) -> Column:
    low = F.when(rows_per_column < profile.rows_per_column, profile.rows_per_column_penalty).otherwise(0.0)
    if profile.name == "universal":
        return clamp(100.0 - 30.0 * issues / float(n_columns) - low, low=0)
    return clamp(100.0 - clamp(60.0 * issues / float(n_columns), high=50) - low, low=0)

"""Pairwise Pearson correlation of number columns."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from plumbline import rules
from plumbline.functions.numeric import clamp
from plumbline.operators.classify import by_role
from plumbline.operators.columns import NUMBER, TableColumn, literal_table, table_columns

SCHEMA = "column_a string, column_b string, r double"
PART_SCHEMA = "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"
# A spread this small beside the size of the numbers is rounding, not variation.
FLAT_SHARE = 1e-13


def correlations(df: DataFrame, columns: list[TableColumn] | None = None) -> DataFrame:
    """(column_a, column_b, r) for each pair, over the rows where both are present.

    Each task multiplies its batches as matrices, so one scan serves all pairs of any
    number of columns, and returns one row per pair. The columns are shifted by their
    means first, so that the sums keep their precision. ``r`` is null where a column is
    constant.
    """
    columns = table_columns(df, NUMBER) if columns is None else columns
    if len(columns) < 2:
        return literal_table(df.sparkSession, [], SCHEMA)
    shifts = _shifts(df, columns)
    shifted = df.select(*[(c.cell - F.lit(shifts.get(c.slot, 0.0))).alias(c.slot) for c in columns])
    parts = shifted.mapInArrow(_pair_sums, PART_SCHEMA)
    n, sa, sb, saa, sbb, sab = (F.sum(name) for name in ("n", "sa", "sb", "saa", "sbb", "sab"))
    spread_a, spread_b = saa - F.try_divide(sa * sa, n), sbb - F.try_divide(sb * sb, n)
    r = F.try_divide(sab - F.try_divide(sa * sb, n), F.sqrt(spread_a) * F.sqrt(spread_b))
    varies = (spread_a > FLAT_SHARE * saa) & (spread_b > FLAT_SHARE * sbb)
    summed = parts.groupBy("a", "b").agg(F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    names = F.array(*[F.lit(c.name) for c in columns])
    return summed.select(names[F.col("a")].alias("column_a"), names[F.col("b")].alias("column_b"),
                         F.nanvl("r", F.lit(None).cast("double")).alias("r"))


def _shifts(df: DataFrame, columns: list[TableColumn]) -> dict[str, float]:
    """The mean of each column; the value itself where it is constant, so that it cancels."""
    row = df.agg(*[F.when(F.min(c.cell) == F.max(c.cell), F.min(c.cell)).otherwise(F.avg(c.cell)).alias(c.slot)
                   for c in columns]).first()
    return {c.slot: row[c.slot] for c in columns if row[c.slot] is not None}


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pair of columns with the counts and sums over the rows where both are present."""
    total = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        present = ~np.isnan(x)
        mask, x = present.astype(float), np.where(present, x, 0.0)
        square = x * x
        sums = np.stack([mask.T @ mask, x.T @ mask, mask.T @ x, square.T @ mask, mask.T @ square, x.T @ x])
        total = sums if total is None else total + sums
    if total is not None:
        a, b = np.triu_indices(total.shape[1], 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(part[a, b]) for part in total]],
            names=["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])


def correlation_matrix(df: DataFrame, columns: list[TableColumn] | None = None) -> DataFrame:
    """The full square as (column_a, column_b, r), the diagonal included; of the columns in the role of a number or with two values, where none are given."""
    columns = table_columns(df, names=by_role(df, "numeric", "binary")) if columns is None else columns
    upper = correlations(df, columns)
    lower = upper.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r")
    varies = df.agg(*[(F.min(c.cell) < F.max(c.cell)).alias(f"c{c.position}") for c in columns])
    diagonal = varies.select(F.inline(F.array(*[
        F.struct(F.lit(c.name).alias("column_a"), F.lit(c.name).alias("column_b"),
                 F.when(F.col(f"c{c.position}"), F.lit(1.0)).alias("r")) for c in columns])))
    return upper.unionByName(lower).unionByName(diagonal)


def high_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with |r| above 0.95; ``perfect`` above 0.999."""
    size = F.abs("r")
    return pairs.where(size > rules.CORRELATION_LIMIT).select(
        "column_a", "column_b", size.alias("abs_r"),
        F.when(size > rules.PERFECT_CORRELATION, "perfect").otherwise("very high").alias("strength"))


def redundant_columns(pairs: DataFrame) -> DataFrame:
    """The second column of each pair above 0.999."""
    return pairs.where(F.abs("r") > rules.PERFECT_CORRELATION).select(F.col("column_b").alias("column")).distinct()


def strength(r: Column) -> Column:
    size = F.abs(r)
    return (F.when(size > 0.9, "very high").when(size > 0.7, "strong")
            .when(size > 0.4, "moderate").when(size.isNotNull(), "weak"))


# The summing function goes to the tasks by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def correlation_score(n_pairs: Column, penalty: float) -> Column:
    return clamp(100.0 - penalty * n_pairs, low=0)

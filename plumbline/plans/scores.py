"""Weights, overall scores, grades and bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import rules
from plumbline.functions.numeric import clamp
from plumbline.operators.columns import table_columns
from plumbline.operators.duplicates import duplicate_counts
from plumbline.operators.profile import null_cells

FIXED_QUICK_SCORE = 80.0


def normalised_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights that sum to 1; user weights must name every dimension and be positive."""
    weights = rules.WEIGHTS if weights is None else weights
    if set(weights) != set(rules.DIMENSIONS):
        raise ValueError(f"weights must name exactly {', '.join(rules.DIMENSIONS)}")
    if not all(isinstance(w, (int, float)) and math.isfinite(w) and w > 0 for w in weights.values()):
        raise ValueError("every weight must be a positive number")
    total = sum(weights.values())
    # The default weights already sum to 1 and stay as they are.
    scale = 1.0 if abs(total - 1.0) < 1e-9 else total
    return {d: weights[d] / scale for d in rules.DIMENSIONS}


def audit_grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("D")


def universal_grade(score: Column) -> Column:
    """The grade of the universal score and the status of each of its dimensions."""
    return (F.when(score >= 90, "Excellent").when(score >= 75, "Good")
            .when(score >= 60, "Fair").when(score >= 40, "Poor").otherwise("Critical"))


def dimension_band(score: Column) -> Column:
    return F.when(score >= 85, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("bad")


def size_factor(n_rows: Column) -> Column:
    return clamp(F.log10(n_rows + 1) / 4.0, low=0.5, high=1.0)


def diversity_factor(df: DataFrame) -> float:
    return min(1.05, 1 + 0.01 * (len({c.dtype for c in table_columns(df)}) - 1))


def adjusted_score(raw: Column, n_rows: Column, diversity: float) -> Column:
    return clamp(raw * size_factor(n_rows) * F.lit(diversity), low=0, high=100)


def quick_score(df: DataFrame) -> DataFrame:
    """One row: completeness and uniqueness alone, the other five dimensions fixed at 80.

    Gives n_rows, null_cells, duplicate_rows, raw score, both factors and the score.
    """
    weights = normalised_weights()
    rest = FIXED_QUICK_SCORE * sum(w for d, w in weights.items() if d not in ("completeness", "uniqueness"))
    duplicates, nulls = duplicate_counts(df), null_cells(df)
    both = duplicates.withColumn("one", F.lit(1)).join(nulls.withColumn("one", F.lit(1)), "one")
    complete = clamp(100.0 - 150.0 * F.try_divide(F.col("null_cells").cast("double"), F.col("cells")), low=0)
    unique = clamp(100.0 - 200.0 * F.try_divide(F.col("duplicate_rows").cast("double"), F.col("n_rows")), low=0)
    raw = weights["completeness"] * complete + weights["uniqueness"] * unique + rest
    diversity = diversity_factor(df)
    return both.select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "null_cells", "duplicate_rows",
        raw.alias("raw"), size_factor(F.col("n_rows")).alias("size_factor"), F.lit(diversity).alias("diversity"),
        F.round(adjusted_score(raw, F.col("n_rows"), diversity), 2).alias("score"))


def score_table(facts: DataFrame, scores: dict[str, Column], weights: dict[str, float]) -> DataFrame:
    """(position, dimension, weight, score, weighted, band) from the one-row facts."""
    rows = [F.struct(F.lit(i).alias("position"), F.lit(d).alias("dimension"), F.lit(weights[d]).alias("weight"),
                     F.round(scores[d], 2).alias("score")) for i, d in enumerate(rules.DIMENSIONS, 1)]
    table = facts.select(F.inline(F.array(*rows)))
    return table.select("*", (F.col("weight") * F.col("score")).alias("weighted"),
                        dimension_band(F.col("score")).alias("band"))

"""Which column costs how much: the loss of every dimension of an audit, split over its columns.

A dimension loses points for one or more causes. Each cause's part of the loss is in proportion to what it would cost alone, which is the
dimension's own score of the table with the other causes taken away; within a cause, columns share by their number of bad cells,
broken rules or findings, and both columns of a pair by half. Causes that no column is to blame for, such as duplicate rows, stand under the whole
table (column null). So the parts of a dimension sum to 100 minus its score, and weighted to 100 minus the raw score.

Everything comes from the evidence of an audit that is already there: a few rows per column, no scan of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.accuracy import skew_penalty
from plumbline.operators.columns import column_names, literal_table, table_columns
from plumbline.plans.audit import AuditResult, dimension_scores

TABLE = "table"


def _causes(result: AuditResult) -> list[tuple[str, str, tuple[str, ...], DataFrame | None]]:
    """(dimension, cause, the facts it consists of, blame): blame is (column, amount), or None for the whole table."""
    def by(source: str, amount: Column | None = None) -> DataFrame:
        return result.details[source].select("column", (F.lit(1.0) if amount is None else amount).cast("double").alias("amount"))

    def halves(source: str) -> DataFrame:
        return result.details[source].select(F.explode(F.array("column_a", "column_b")).alias("column"), F.lit(0.5).alias("amount"))

    universal = result.profile.name == "universal"
    found = [
        ("completeness", "missing cells", ("missing_rate",), by("missing", F.col("missing_cells"))),
        ("uniqueness", "duplicate rows", ("duplicate_rows",), None),
        ("uniqueness", "constant columns", ("constant_columns",), by("constant")),
        ("uniqueness", "identical columns", ("identical_pairs",), halves("identical")),
        ("consistency", "mixed forms", ("issues",), by("issues")),
        ("validity", "outliers", ("outlier_cells",), by("outliers", F.col("outliers"))),
        ("validity", "impossible values", ("rules_hit", "impossible_cells"), by("impossible", F.col("bad_values") if universal else None)),
        ("structure", "names and number texts", ("bad_names", "text_numbers"), by("names").unionByName(by("text_numbers"))),
        ("structure", "few rows", ("rows_per_column",), None),
        ("correlation", "correlated pairs", ("high_pairs",), halves("pairs")),
    ]
    if universal:
        return found + [("uniqueness", "near rows", ("near_pct",), None), ("accuracy", "skew", ("skew_penalty",), by("skewed", skew_penalty(F.col("skewness")))),
                        ("accuracy", "imbalance", ("imbalanced_columns",), by("imbalanced"))]
    return found + [("accuracy", "skew", ("skewed_columns",), by("skewed")), ("accuracy", "noisy labels", ("noisy_labels",), by("noise", F.col("noisy_labels")))]


def _alone(df: DataFrame, result: AuditResult, causes: list) -> dict[tuple[str, str], float]:
    """What each cause would cost if it were the only one."""
    facts = result.facts.first().asDict()
    concerned = {f for _, _, own, _ in causes for f in own}
    rows = []
    for dimension, cause, own, _ in causes:
        kept = {k: v if k not in concerned or k in own else (float("inf") if k == "rows_per_column" else 0) for k, v in facts.items()}
        rows.append((dimension, cause, *kept.values()))
    schema = "dimension string, cause string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in result.facts.schema.fields)
    scores = dimension_scores(df, result.profile)
    scored = literal_table(df.sparkSession, rows, schema).select("dimension", "cause", *[F.coalesce(c, F.lit(100.0)).alias(f"d_{d}") for d, c in scores.items()])
    return {(r.dimension, r.cause): 100.0 - r[f"d_{r.dimension}"] for r in scored.collect()}  # a row per cause


def column_losses(df: DataFrame, result: AuditResult) -> DataFrame:
    """(position, column, dimension, cause, loss, points): ``loss`` in points of the dimension, ``points`` of the raw score."""
    causes = _causes(result)
    alone = _alone(df, result, causes)
    table = {r.dimension: (r.score, r.weight) for r in result.scores.select("dimension", "score", "weight").collect()}
    parts = []
    for dimension, cause, _, blame in causes:
        score, weight = table[dimension]
        total = sum(v for (d, _), v in alone.items() if d == dimension)
        share = alone[(dimension, cause)] / total if total else 0.0
        loss = (100.0 - score) * share
        if not loss:
            continue
        if blame is None:
            parts.append(literal_table(df.sparkSession, [(None, dimension, cause, loss, loss * weight)], "column string, dimension string, cause string, loss double, points double"))
            continue
        summed = blame.groupBy("column").agg(F.sum("amount").alias("amount")).where("amount > 0")
        every = summed.agg(F.sum("amount").alias("all")).first()["all"]
        parts.append(summed.select("column", F.lit(dimension).alias("dimension"), F.lit(cause).alias("cause"), (F.col("amount") / every * loss).alias("loss"),
                                   (F.col("amount") / every * loss * weight).alias("points")))
    if not parts:
        return literal_table(df.sparkSession, [], "position int, column string, dimension string, cause string, loss double, points double")
    names = F.broadcast(column_names(df.sparkSession, table_columns(df)).select("position", "column"))
    return reduce(DataFrame.unionByName, parts).join(names, "column", "left").select("position", "column", "dimension", "cause", "loss", "points")


def column_scores(df: DataFrame, result: AuditResult) -> DataFrame:
    """(position, column, points, score, worst_dimension) of every column and, where it loses points, of the whole table (position null).

    ``points`` is what the column costs the raw score; ``score`` is what the table would have if all columns were like it
    (100 less the points times the number of columns, 0 at least), and null for the whole table.
    """
    losses = column_losses(df, result)
    per = losses.groupBy("position", "column", "dimension").agg(F.sum("points").alias("points"))
    summed = per.groupBy("position", "column").agg(F.sum("points").alias("points"), F.max(F.struct("points", "dimension"))["dimension"].alias("worst_dimension"))
    columns = column_names(df.sparkSession, table_columns(df)).select("position", "column")
    whole = summed.where("position IS NULL").select("position", "column", "points", F.lit(None).cast("double").alias("score"), "worst_dimension")
    points = F.coalesce("points", F.lit(0.0))
    each = columns.join(summed.drop("column"), "position", "left").select(
        "position", "column", points.alias("points"), F.greatest(F.lit(0.0), 100.0 - points * len(df.columns)).alias("score"), "worst_dimension")
    return each.unionByName(whole)

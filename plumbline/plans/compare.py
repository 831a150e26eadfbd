"""Before and after cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.columns import literal_table, normalise
from plumbline.plans.scores import quick_score


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) for rows, columns, missing cells and the quick score."""
    names = {"rows": "n_rows", "columns": "n_columns", "missing_cells": "null_cells", "score": "score"}
    old, new = quick_score(normalise(before)).first(), quick_score(normalise(after)).first()
    rows = [(label, float(old[name]), float(new[name]), float(new[name]) - float(old[name]))
            for label, name in names.items()]
    return literal_table(before.sparkSession, rows, "metric string, before double, after double, delta double")

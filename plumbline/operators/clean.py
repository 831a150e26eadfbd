"""The eight cleaning steps, in their fixed order.

Steps 1 to 5 are projections and filters with literals from O(columns) aggregates. Step 6
is the one shuffle of whole rows; its result is staged, because the quartiles of step 8
are those of the deduplicated table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, functions as F

from plumbline import rules
from plumbline.functions.text import is_placeholder, normalised, stripped
from plumbline.operators.columns import NUMBER, STRING, Metric, ALL_KINDS, canonical, column_metrics, normalise, table_columns
from plumbline.operators.duplicates import repeated_and_single
from plumbline.operators.frequencies import modes
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.validity import fences, outside, quartiles
from plumbline.sources.staging import staged

FILL_WITHOUT_MODE = "unknown"
PREVIEW_ROWS = 20
INTEGERS = ("tinyint", "smallint", "int", "bigint")
PRESENT = [Metric("present", "bigint", ALL_KINDS, F.count)]


def clean_names(names: list[str]) -> list[str]:
    """Lower-case names of letters, digits and single underscores; clashes get a number."""
    taken: set[str] = set()
    result = []
    for i, name in enumerate(names):
        base = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", name.strip().lower())).strip("_") or f"col_{i}"
        fresh, k = base, 1
        while fresh in taken:
            k += 1
            fresh = f"{base}_{k}"
        taken.add(fresh)
        result.append(fresh)
    return result


def rename_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    any_value = F.lit(False)
    for c in table_columns(df):
        any_value = any_value | c.ref.isNotNull()
    return df.where(any_value)


def null_placeholders(df: DataFrame) -> DataFrame:
    """Placeholder text becomes null; blank text is not a placeholder and stays."""
    return df.withColumns({c.name: F.when(~is_placeholder(stripped(c.ref)), c.ref) for c in table_columns(df, STRING)})


def present_cells(df: DataFrame) -> dict[str, Row]:
    """Non-null cells and rows of each column."""
    return {r.column: r for r in sorted(column_metrics(df, PRESENT).collect(), key=lambda r: r.position)}


def sparse_columns(df: DataFrame, stats: dict[str, Row] | None = None) -> list[str]:
    """Columns with fewer non-null cells than 30 % of the rows, rounded down."""
    stats = present_cells(df) if stats is None else stats
    return [name for name, r in stats.items() if r.present < int(rules.KEEP_COLUMN_SHARE * r.n_rows)]


def drop_sparse_columns(df: DataFrame, stats: dict[str, Row] | None = None) -> DataFrame:
    dropped = set(sparse_columns(df, stats))
    return df.select(*[c.ref for c in table_columns(df) if c.name not in dropped])


def fill_values(df: DataFrame, stats: dict[str, Row] | None = None) -> dict[str, float | str]:
    """What fills each column with nulls: the median of numbers, the mode of text."""
    stats = present_cells(df) if stats is None else stats
    gaps = [c for c in table_columns(df, NUMBER, STRING) if stats[c.name].present < stats[c.name].n_rows]
    numbers = [c for c in gaps if c.kind == NUMBER]
    texts = [c for c in gaps if c.kind == STRING]
    found: dict[str, float | str] = {c.name: FILL_WITHOUT_MODE for c in texts}
    if texts:
        found |= {r.column: r["mode"] for r in modes(df, texts).collect()}
    if numbers:
        found |= {name: q[0] for name, q in exact_quantiles(df, numbers, [0.5]).items() if q[0] is not None}
    return found


def fill_missing(df: DataFrame, stats: dict[str, Row] | None = None) -> DataFrame:
    """Number columns with nulls become double; all-null number columns stay null."""
    fills = fill_values(df, stats)
    return df.withColumns({c.name: F.coalesce(c.ref.cast("double") if c.kind == NUMBER else c.ref, F.lit(fills[c.name]))
                           for c in table_columns(df, NUMBER, STRING) if c.name in fills})


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each group of equal rows; every column counts, maps and variants by their content."""
    repeated, single = repeated_and_single(df)
    if repeated is None:
        return _one_of_each(df)
    return single.unionByName(_one_of_each(repeated))


def _one_of_each(df: DataFrame) -> DataFrame:
    names = [c.name for c in table_columns(df) if c.groupable]
    nested = {f"__key_{c.position}": canonical(c.ref, df.schema[c.name].dataType) for c in table_columns(df) if not c.groupable}
    return df.withColumns(nested).dropDuplicates([*names, *nested]).drop(*nested) if nested else df.dropDuplicates(names)


def tidy_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c.name: normalised(c.ref) for c in table_columns(df, STRING)})


def cap_outliers(df: DataFrame) -> DataFrame:
    """Numbers beyond three quartile ranges move to the fence.

    An integer column keeps its type unless a cell is capped.
    """
    numbers = table_columns(df, NUMBER)
    bounds = {name: fences(*q, rules.EXTREME_FENCE) for name, q in quartiles(df, numbers).items()}
    bounds = {name: b for name, b in bounds.items() if b}
    whole = [c for c in numbers if c.name in bounds and c.dtype in INTEGERS]
    if whole:
        row = df.agg(*[F.bool_or(outside(c.ref.cast("double"), bounds[c.name])).alias(f"c{c.position}") for c in whole]).first()
        for c in whole:
            if not row[f"c{c.position}"]:
                del bounds[c.name]
    capped = {}
    for c in numbers:
        if c.name in bounds:
            low, high = bounds[c.name]
            value = c.ref.cast("double")
            capped[c.name] = F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)
    return df.withColumns(capped) if capped else df


def clean(df: DataFrame) -> DataFrame:
    """All eight steps; the last two are lazy over the staged, deduplicated table."""
    df = null_placeholders(drop_empty_rows(rename_columns(normalise(df))))
    stats = present_cells(df)  # for both of the next steps, which change no row
    df = fill_missing(drop_sparse_columns(df, stats), stats)
    # Not by digest: the steps before are lazy, and digests would run them three times.
    return cap_outliers(tidy_text(staged(_one_of_each(df), "deduplicated")))


def preview(df: DataFrame, order_by: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(*order_by).limit(n)

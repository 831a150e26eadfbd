"""Rules of the user's own: conditions on rows, references to other tables, dependencies between columns.

Rules are compiled before they run. All conditions on rows become one aggregate over one scan, however many there are;
references with the same key columns share one grouping of the keys; each dependency is a two-level aggregate. Keys
and determinants are grouped before they are joined, so a value that a third of the rows shares is one row a task.

A condition is an SQL expression over the columns of a row. As in a CHECK constraint, a row breaks it
if it is false; where it is null the row isn't judged. A reference isn't judged where a key column
is null. A dependency (``columns`` decide ``decides``) is broken by every group that holds more than one value; the rows
beyond its most frequent value are the broken ones. Null is a value in ``decides``, and in ``columns`` too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.columns import column_ref, literal_table

ERROR, WARNING = "error", "warning"
DROP = "drop"


@dataclass(frozen=True)
class RowRule:
    """``fix``: what ``apply_fixes`` does with a broken row: ``DROP``, or an SQL expression for each column to replace."""

    name: str
    condition: str
    severity: str = ERROR
    fix: str | tuple[tuple[str, str], ...] | None = None


@dataclass(frozen=True)
class Reference:
    """Every key must occur in ``target`` of ``check_rules(..., targets=...)``."""

    name: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    severity: str = ERROR


@dataclass(frozen=True)
class Dependency:
    name: str
    columns: tuple[str, ...]
    decides: str
    severity: str = WARNING


Rule = RowRule | Reference | Dependency
_RESULT = ["rule", "checked", "broken"]


def _named(rules: Sequence[Rule]) -> None:
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("two rules have the same name")


def _row_results(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """One aggregate for all conditions."""
    counts = []
    for n, rule in enumerate(rules):
        condition = F.expr(rule.condition).cast("boolean")
        counts += [F.count(condition).alias(f"checked{n}"), F.count_if(~condition).alias(f"broken{n}")]
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"checked{n}").alias("checked"), F.col(f"broken{n}").alias("broken"))
                       for n, r in enumerate(rules)])
    return df.agg(*counts).select(F.inline(listed))


def _key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key, n) of the rows whose key columns are all filled."""
    refs = [column_ref(c) for c in columns]
    filled = reduce(lambda a, b: a & b, [r.isNotNull() for r in refs])
    return df.where(filled).groupBy(*[r.alias(f"k{n}") for n, r in enumerate(refs)]).agg(F.count("*").alias("n"))


def broken_references(df: DataFrame, rule: Reference, target: DataFrame) -> DataFrame:
    """The keys without a partner and how many rows hold each; the columns are named as in ``df``."""
    return _without_partner(_key_counts(df, rule.columns), rule, target).select(
        *[F.col(f"k{n}").alias(c) for n, c in enumerate(rule.columns)], F.col("n").alias("rows"))


def _without_partner(keys: DataFrame, rule: Reference, target: DataFrame) -> DataFrame:
    names = [f"k{n}" for n in range(len(rule.columns))]
    return keys.join(target.select(*[column_ref(c).alias(k) for c, k in zip(rule.target_columns, names)]).distinct(), names, "left_anti")


def _reference_results(df: DataFrame, rules: Sequence[Reference], targets: dict[str, DataFrame]) -> list[DataFrame]:
    found = []
    for columns in dict.fromkeys(r.columns for r in rules):
        keys = _key_counts(df, columns)
        for rule in (r for r in rules if r.columns == columns):
            lost = _without_partner(keys, rule, targets[rule.target]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("broken"))
            every = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"))
            both = every.select(F.lit(rule.name).alias("rule"), "checked", F.lit(0).cast("long").alias("broken")).unionByName(
                lost.select(F.lit(rule.name).alias("rule"), F.lit(0).cast("long").alias("checked"), "broken"))
            found.append(both.groupBy("rule").agg(F.sum("checked").alias("checked"), F.sum("broken").alias("broken")))
    return found


def dependency_groups(df: DataFrame, rule: Dependency) -> DataFrame:
    """One row per group of the deciding columns: its rows, its number of values and the rows beyond the most frequent value."""
    refs = [column_ref(c).alias(f"k{n}") for n, c in enumerate(rule.columns)]
    pairs = df.groupBy(*refs, column_ref(rule.decides).alias("value")).agg(F.count("*").alias("n"))
    return pairs.groupBy(*[f"k{n}" for n in range(len(refs))]).agg(
        F.sum("n").alias("rows"), F.count("*").alias("values"), (F.sum("n") - F.max("n")).alias("broken"))


def broken_dependencies(df: DataFrame, rule: Dependency) -> DataFrame:
    """The groups that hold more than one value, under the names of their columns."""
    return dependency_groups(df, rule).where("values > 1").select(
        *[F.col(f"k{n}").alias(c) for n, c in enumerate(rule.columns)], "rows", "values", "broken")


def check_rules(df: DataFrame, rules: Sequence[Rule], targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per rule: position, rule, kind, severity, checked, broken, broken_share and passed."""
    _named(rules)
    rows = [r for r in rules if isinstance(r, RowRule)]
    parts = [_row_results(df, rows)] if rows else []
    parts += _reference_results(df, [r for r in rules if isinstance(r, Reference)], targets or {})
    for rule in (r for r in rules if isinstance(r, Dependency)):
        parts.append(dependency_groups(df, rule).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("checked"),
                                                     F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"))
                     .select(F.lit(rule.name).alias("rule"), "checked", "broken"))
    kinds = {RowRule: "row", Reference: "reference", Dependency: "dependency"}
    listed = literal_table(df.sparkSession, [(n, r.name, kinds[type(r)], r.severity) for n, r in enumerate(rules)],
                           "position int, rule string, kind string, severity string")
    if not parts:
        return listed.selectExpr("*", "0L AS checked", "0L AS broken", "0.0D AS broken_share", "true AS passed")
    found = reduce(DataFrame.unionByName, [p.select(*_RESULT) for p in parts])
    return found.join(F.broadcast(listed), "rule").select(
        "position", "rule", "kind", "severity", "checked", "broken",
        F.coalesce(F.try_divide("broken", "checked"), F.lit(0.0)).alias("broken_share"), (F.col("broken") == 0).alias("passed"))


def broken_rows(df: DataFrame, rules: Sequence[RowRule], column: str = "broken_rules") -> DataFrame:
    """The rows that break a condition, with the names of the broken rules in ``column``; one scan."""
    _named(rules)
    listed = F.filter(F.array(*[F.when(~F.expr(r.condition).cast("boolean"), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return df.withColumn(column, listed).where(F.size(column_ref(column)) > 0)


def broken_dependency_rows(df: DataFrame, rule: Dependency) -> DataFrame:
    """The rows whose value isn't the most frequent one of their group (of equally frequent ones the smallest stays)."""
    pairs = df.groupBy(*[column_ref(c).alias(f"__k{n}") for n, c in enumerate(rule.columns)], column_ref(rule.decides).alias("__value")).agg(F.count("*").alias("__n"))
    group = [f"__k{n}" for n in range(len(rule.columns))]
    best = pairs.groupBy(*group).agg(F.min(F.struct((-F.col("__n")).alias("less"), F.col("__value").isNull().alias("empty"), F.col("__value").alias("value")))
                                     .alias("__best"), F.count("*").alias("__values")).where("__values > 1")
    same = reduce(lambda a, b: a & b, [column_ref(c).eqNullSafe(F.col(k)) for c, k in zip(rule.columns, group)])
    return df.join(best, same).where(~column_ref(rule.decides).eqNullSafe(F.col("__best.value"))).select(*[column_ref(c) for c in df.columns])


def apply_fixes(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """Cleaning by rules, in their order: each sees what the ones before it left. Rules without a fix change nothing."""
    _named(rules)
    for rule in (r for r in rules if r.fix is not None):
        broken = F.coalesce(~F.expr(rule.condition).cast("boolean"), F.lit(False))
        if rule.fix == DROP:
            df = df.where(~broken)
        else:
            df = df.withColumns({c: F.when(broken, F.expr(e)).otherwise(column_ref(c)).cast(df.schema[c].dataType) for c, e in rule.fix})
    return df

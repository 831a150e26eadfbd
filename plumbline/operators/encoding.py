"""Encodings that are fitted on one table, stored, and applied to another: scaling, frequencies, one-hot, target means.

Fitted parameters are an ordinary table (step, column, key, a, b), so they can be written as Parquet beside a model and read
back for the next table. ``apply_encodings`` adds columns and keeps the ones it reads. Every step has a slot for what the
fitted table didn't hold: an unseen category has frequency 0, the ``other`` column, or the overall target mean.

Scaling takes exact quantiles. Categories are counted in the tasks before the shuffle. One-hot columns are bounded by
``most``; parameters that grow with the categories (frequencies, target means) are joined, never collected.

Out-of-fold target encoding: the target mean of a row's category over all *other* folds, drawn to the mean of those folds by
``prior`` rows. Folds come from a digest of the row's key, so reruns and other tables agree. No row sees its own target.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.columns import BOOLEAN, NUMBER, column_metrics, column_ref, literal_table, Metric, table_columns
from plumbline.operators.quantiles import exact_quantiles

STANDARD, SPAN, ROBUST = "standard", "span", "robust"
FREQUENCY, ONE_HOT, TARGET = "frequency", "one_hot", "target"
MOST_CATEGORIES = 20
FOLDS = 5
PRIOR = 20.0
_SCHEMA = "step string, column string, key string, a double, b double"
_MOMENTS = [Metric("mean", "double", (NUMBER, BOOLEAN), F.avg), Metric("deviation", "double", (NUMBER, BOOLEAN), F.stddev_samp),
            Metric("low", "double", (NUMBER, BOOLEAN), F.min), Metric("high", "double", (NUMBER, BOOLEAN), F.max)]


def fit_scaling(df: DataFrame, columns: Sequence[str], method: str = STANDARD) -> DataFrame:
    """One row per column: a value becomes (value - a) / b, with mean and deviation (``STANDARD``), smallest value and span (``SPAN``)
    or median and quartile distance (``ROBUST``)."""
    chosen = table_columns(df, NUMBER, BOOLEAN, names=columns)
    if method == ROBUST:
        found = exact_quantiles(df, chosen, [0.25, 0.5, 0.75])
        rows = []
        for c in chosen:
            low, middle, high = found[c.name]
            rows.append((method, c.name, None, middle, None if low is None else high - low))
        return literal_table(df.sparkSession, rows, _SCHEMA)
    if method not in (STANDARD, SPAN):
        raise ValueError(f"unknown scaling: {method!r}")
    a, b = ("mean", F.col("deviation")) if method == STANDARD else ("low", F.col("high") - F.col("low"))
    return column_metrics(df, _MOMENTS, chosen).select(F.lit(method).alias("step"), "column", F.lit(None).cast("string").alias("key"), F.col(a).alias("a"), b.alias("b"))


def _category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, key, n); the key of null is null."""
    return reduce(DataFrame.unionByName, [
        df.groupBy(c.ref.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(c.name).alias("column"), "key", "n")
        for c in table_columns(df, names=columns)])


def fit_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The share of each category; nulls count as a category."""
    counts = _category_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(totals, "column").select(F.lit(FREQUENCY).alias("step"), "column", "key", (F.col("n") / F.col("total")).alias("a"), F.col("n").cast("double").alias("b"))


def fit_one_hot(df: DataFrame, columns: Sequence[str], most: int = MOST_CATEGORIES) -> DataFrame:
    """The ``most`` most frequent categories of each column (ties by value), numbered from 1 in ``a``; nulls have no column of their own."""
    parts = []
    for c in table_columns(df, names=columns):
        counts = _category_counts(df, [c.name]).where("key IS NOT NULL").orderBy(F.desc("n"), "key").limit(most)
        ranked = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "key"))).alias("x")).select(F.posexplode("x").alias("pos", "x"))
        parts.append(ranked.select(F.lit(ONE_HOT).alias("step"), F.lit(c.name).alias("column"), "x.key", (F.col("pos") + 1).cast("double").alias("a"),
                                   (-F.col("x.less")).cast("double").alias("b")))
    return reduce(DataFrame.unionByName, parts)


def fit_target(df: DataFrame, columns: Sequence[str], target: str, prior: float = PRIOR) -> DataFrame:
    """The target mean of each category over the whole table, drawn to the overall mean by ``prior`` rows; for tables without a target.
    The row with b = -1 holds the overall mean, which unseen categories get."""
    value = column_ref(target).cast("double")
    overall = df.agg(F.avg(value).alias("mean"))
    parts = []
    for c in table_columns(df, names=columns):
        sums = df.where(value.isNotNull()).groupBy(c.ref.cast("string").alias("key")).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
        mean = overall.first()["mean"]
        if mean is None:
            continue
        parts.append(sums.select(F.lit(TARGET).alias("step"), F.lit(c.name).alias("column"), "key",
                                 ((F.col("s") + F.lit(prior * mean)) / (F.col("n") + F.lit(prior))).alias("a"), F.col("n").cast("double").alias("b")))
        parts.append(literal_table(df.sparkSession, [(TARGET, c.name, None, mean, -1.0)], _SCHEMA))
    return reduce(DataFrame.unionByName, parts) if parts else literal_table(df.sparkSession, [], _SCHEMA)


def _joined(df: DataFrame, column: str, own: DataFrame, result: str, default: Column) -> DataFrame:
    """Adds ``own.a`` of each row's category as ``result``."""
    named = own.select(F.col("key").alias("__key"), F.col("a").alias("__a"), F.lit(True).alias("__known"))
    found = df.join(named, column_ref(column).cast("string").eqNullSafe(F.col("__key")), "left")
    return found.withColumn(result, F.when(F.col("__known"), F.col("__a")).otherwise(default)).drop("__key", "__a", "__known")


def _slot(category: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in category)


def apply_encodings(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds the columns that the fitted table describes: ``x_standard``, ``x_span``, ``x_robust``, ``x_frequency``, ``x_target``, and for one-hot
    ``x_1`` and so on by the category's number, ``x_other`` and ``x_null``. Scaled columns without spread become 0."""
    steps = [(r.step, r.column) for r in fitted.select("step", "column").distinct().orderBy("step", "column").collect()]  # a row per column and step
    for step, column in steps:
        own = fitted.where((F.col("step") == step) & (F.col("column") == column))
        if step in (STANDARD, SPAN, ROBUST):
            row = own.first()
            value = column_ref(column).cast("double")
            scaled = F.lit(None).cast("double") if row.a is None or row.b is None else F.when(value.isNotNull(), (value - row.a) / row.b if row.b else F.lit(0.0))
            df = df.withColumn(f"{column}_{step}", scaled)
        elif step == FREQUENCY:
            df = _joined(df, column, own, f"{column}_{step}", F.lit(0.0))
        elif step == TARGET:
            df = _joined(df, column, own.where("b >= 0"), f"{column}_{step}", F.lit(own.where("b < 0").first().a))
        else:
            keys = [r.key for r in own.orderBy("a").collect()]  # at most ``most``
            value = column_ref(column).cast("string")
            df = df.withColumns({f"{column}_{n}": F.coalesce(value == key, F.lit(False)).cast("int") for n, key in enumerate(keys, 1)} | {
                f"{column}_other": F.coalesce(~value.isin(keys), F.lit(False)).cast("int"), f"{column}_null": value.isNull().cast("int")})
    return df


def one_hot_legend(fitted: DataFrame) -> DataFrame:
    """(column, number, category, n) of the one-hot columns."""
    return fitted.where(F.col("step") == ONE_HOT).select("column", F.col("a").cast("int").alias("number"), F.col("key").alias("category"), F.col("b").cast("long").alias("n"))


def fold(key: Column, folds: int = FOLDS) -> Column:
    """The fold of a row, from 28 bits of the MD5 digest of its key."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(folds)).cast("int")


def target_encoding(df: DataFrame, column: str, target: str, key: str, folds: int = FOLDS, prior: float = PRIOR) -> DataFrame:
    """Adds ``<column>_target``, the out-of-fold target mean of each row's category. A null category is a category; rows without a target
    are encoded and not counted. Null where no other fold has a target."""
    value = column_ref(target).cast("double")
    marked = df.withColumn("__fold", fold(column_ref(key), folds))
    cells = marked.groupBy(column_ref(column).alias("__category"), "__fold").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.count(value).alias("n"))
    per_fold = {r["__fold"]: (r.s, r.n) for r in cells.groupBy("__fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}  # a row per fold
    sums, rows = (sum(x[k] for x in per_fold.values()) for k in (0, 1))
    means = [(f, (sums - s) / (rows - n)) for f, (s, n) in sorted(per_fold.items()) if rows > n]
    mean = reduce(lambda c, x: c.when(F.col("__fold") == x[0], F.lit(x[1])), means, F.when(F.lit(False), F.lit(0.0)))
    totals = cells.groupBy("__category").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    both = cells.alias("c").join(totals.alias("t"), F.col("c.__category").eqNullSafe(F.col("t.__category"))).select(
        F.col("c.__category").alias("__own"), F.col("__fold").alias("__own_fold"),
        ((F.col("all_s") - F.col("s") + prior * mean) / (F.col("all_n") - F.col("n") + prior)).alias(f"{column}_target"))
    found = marked.join(both, column_ref(column).eqNullSafe(F.col("__own")) & (F.col("__fold") == F.col("__own_fold")), "left")
    return found.drop("__fold", "__own", "__own_fold")

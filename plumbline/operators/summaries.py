"""Summaries of several tables that add up, and the drift between them.

A summary is a table of counts: for every source and column, how many cells fall into each bin. It is
made in one grouped aggregate per column family, is bounded per column whatever the number of rows, and two
summaries of parts of a source are merged by adding counts. Tables are compared on summaries alone, so a
stored one makes the next comparison free of the data it came from.

Bins. Numbers: the value rounded to ``NUMBER_BITS`` significant binary digits (a relative width of 0.1 %), a
form that is the same on every machine; infinities have bins of their own and numbers beyond 1e290 share one on each side. Times:
the month. Booleans: the value. Texts and nested values: the first three hex digits of the MD5 digest, 4,096 bins. Nulls
(and NaN) are counted beside the bins.

Drift. ``psi`` is the population stability index: numbers and times over tenths of the base, the others over all
bins, with half a cell added to every bin. ``distance`` is the largest distance of the two distributions (Kolmogorov-Smirnov) for
numbers and times and the total variation distance of the bins for the rest. Columns that one side lacks, or holds in another kind,
are reported as such and not compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.operators.columns import (
    BOOLEAN, DATETIME, NUMBER, STRING, TableColumn, blocks, cells, column_names, table_columns,
)

NUMBER_BITS = 11
LARGEST = 1e290
TENTHS = 10
DRIFTED = 0.25
SHIFTED = 0.1
_SPLIT = float(2 ** (53 - NUMBER_BITS) + 1)


def _number_bin(value: Column) -> Column:
    """Rounds to the nearest number of ``NUMBER_BITS`` digits by multiplying up and subtracting again, which is exact in IEEE arithmetic."""
    held = F.least(F.greatest(value, F.lit(-LARGEST)), F.lit(LARGEST))
    raised = held * _SPLIT
    return F.when(F.abs(value) == float("inf"), value).when(value.isNotNull(), raised - (raised - held) + 0.0)


def _bin(c: TableColumn) -> Column:
    """The bin as text: sortable forms aren't needed, since ordered kinds keep a number beside it."""
    if c.kind == BOOLEAN:
        return c.ref.cast("string")
    return F.substring(F.md5(c.cell.cast("binary")), 1, 3)


def _ordered(c: TableColumn) -> Column:
    if c.kind == DATETIME:
        time = c.ref.cast("timestamp")
        return (F.year(time) * 12 + F.month(time) - 1).cast("double")
    return _number_bin(c.cell)


def summarise(df: DataFrame, source: str | Column = "table") -> DataFrame:
    """(source, column, dtype, kind, place, bin, n): ``place`` is the bin of an ordered column, ``bin`` that of another.

    ``source`` names the table, or is a column of it that tells its rows' source. Nulls have neither
    place nor bin. A column without rows isn't listed. Comparing reads a summary several times, so store it first (``staged``).
    """
    own = F.lit(source) if isinstance(source, str) else source
    hidden = [c.name for c in table_columns(df) if not isinstance(source, str) and str(source) == str(c.ref)]
    columns = [c for c in table_columns(df) if c.name not in hidden]
    parts = []
    for family, value, kind in (((NUMBER,), _ordered, "place"), ((DATETIME,), _ordered, "place"), ((BOOLEAN,), _bin, "bin"), ((STRING, "other"), _bin, "bin")):
        for block in blocks([c for c in columns if c.kind in family]):
            data = cells(df.withColumn("__source", own), block, value, keep=["__source"])
            counted = data.groupBy("__source", "slot", "value").agg(F.count("*").alias("n"))
            place = F.col("value") if kind == "place" else F.lit(None).cast("double")
            label = F.col("value") if kind == "bin" else F.lit(None).cast("string")
            parts.append(counted.select(F.col("__source").alias("source"), "slot", place.alias("place"), label.alias("bin"), "n"))
    names = F.broadcast(column_names(df.sparkSession, columns))
    return reduce(DataFrame.unionByName, parts).join(names, "slot").select("source", "column", "dtype", "kind", "place", "bin", "n")


def merged(*summaries: DataFrame) -> DataFrame:
    """One summary of all parts; counts of equal bins add up."""
    every = reduce(DataFrame.unionByName, summaries)
    return every.groupBy("source", "column", "dtype", "kind", "place", "bin").agg(F.sum("n").alias("n"))


def _is_ordered() -> Column:
    return F.col("kind").isin(NUMBER, DATETIME)


def _totals(summary: DataFrame) -> DataFrame:
    filled = F.col("place").isNotNull() | F.col("bin").isNotNull()
    return summary.groupBy("source", "column", "dtype", "kind").agg(
        F.sum("n").alias("rows"), F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("filled"))


def _aligned(summary: DataFrame, base: str) -> DataFrame:
    """One row for every (source, column, bin) with the counts of both sides; only columns of one kind in both."""
    totals = _totals(summary)
    own = totals.where(F.col("source") == base).select("column", "kind", F.col("filled").alias("base_filled"))
    others = totals.where(F.col("source") != base).select("source", "column", "kind", F.col("filled").alias("other_filled"))
    pairs = others.join(own, ["column", "kind"]).where("base_filled > 0 AND other_filled > 0")
    bins = summary.where(F.col("place").isNotNull() | F.col("bin").isNotNull()).groupBy("source", "column", "kind", "place", "bin").agg(F.sum("n").alias("n"))
    left = pairs.join(bins.where(F.col("source") == base).drop("source"), ["column", "kind"]).select(
        *pairs.columns, "place", "bin", F.col("n").alias("base_n"), F.lit(0).cast("long").alias("other_n"))
    right = pairs.join(bins, ["source", "column", "kind"]).select(
        *pairs.columns, "place", "bin", F.lit(0).cast("long").alias("base_n"), F.col("n").alias("other_n"))
    return left.unionByName(right).groupBy(*pairs.columns, "place", "bin").agg(F.sum("base_n").alias("base_n"), F.sum("other_n").alias("other_n"))


def drift(summary: DataFrame, base: str) -> DataFrame:
    """One row per other source and column that both sides hold in one kind: psi, distance and drifted."""
    aligned = _aligned(summary, base)
    pair = ["source", "column", "kind", "base_filled", "other_filled"]
    order = Window.partitionBy("source", "column").orderBy("place")
    ordered = aligned.where(_is_ordered()).select(
        *pair, "base_n", "other_n",
        F.sum("base_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("base_below"),
        F.sum("other_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("other_below"))
    # A bin belongs to the tenth of the base in which it starts.
    tenth = F.least(F.lit(TENTHS - 1), F.floor((F.col("base_below") - F.col("base_n")) * TENTHS / F.col("base_filled")))
    gap = F.max(F.abs(F.col("base_below") / F.col("base_filled") - F.col("other_below") / F.col("other_filled")))
    tenths = ordered.groupBy(*pair, tenth.alias("part")).agg(F.sum("base_n").alias("base_n"), F.sum("other_n").alias("other_n"), gap.alias("gap"))
    share = F.abs(F.col("base_n") / F.col("base_filled") - F.col("other_n") / F.col("other_filled"))
    rest = aligned.where(~_is_ordered()).select(*pair, "base_n", "other_n", (share / 2).alias("gap"))
    found = []
    for parts, distance in ((tenths, F.max("gap")), (rest, F.sum("gap"))):
        per = Window.partitionBy("source", "column")
        sized = parts.withColumn("parts", F.count("*").over(per))
        p = (F.col("base_n") + 0.5) / (F.col("base_filled") + 0.5 * F.col("parts"))
        q = (F.col("other_n") + 0.5) / (F.col("other_filled") + 0.5 * F.col("parts"))
        found.append(sized.groupBy(*pair).agg(F.sum((p - q) * F.log(p / q)).alias("psi"), distance.alias("distance")))
    level = F.when(F.col("psi") >= DRIFTED, "drifted").when(F.col("psi") >= SHIFTED, "shifted").otherwise("stable")
    return found[0].unionByName(found[1]).withColumn("level", level).select("source", "column", "psi", "distance", "level")


def compare(summary: DataFrame, base: str) -> DataFrame:
    """One row per other source and column of either side: whether its schema agrees, null shares, psi, distance and level."""
    totals = _totals(summary)
    own = totals.where(F.col("source") == base).select("column", F.col("dtype").alias("base_dtype"), F.col("kind").alias("base_kind"),
                                                       F.col("rows").alias("base_rows"), F.col("filled").alias("base_filled"))
    others = totals.where(F.col("source") != base)
    base_columns = F.array(*[F.lit(r.column) for r in own.select("column").collect()]).cast("array<string>")  # one name per column
    wanted = others.select("source").distinct().select("source", F.explode(base_columns).alias("column")).unionByName(others.select("source", "column")).distinct()
    joined = (wanted.join(own, "column", "left").join(others.select("source", "column", "dtype", "kind", "rows", "filled"), ["source", "column"], "left"))
    schema = (F.when(F.col("dtype").isNull(), "missing").when(F.col("base_dtype").isNull(), "added")
              .when(F.col("kind") != F.col("base_kind"), "other kind").when(F.col("dtype") != F.col("base_dtype"), "other type").otherwise("same"))
    return joined.join(drift(summary, base), ["source", "column"], "left").select(
        "source", "column", schema.alias("schema"), "base_dtype", "dtype", "base_rows", "rows",
        (1 - F.col("base_filled") / F.col("base_rows")).alias("base_null_share"), (1 - F.col("filled") / F.col("rows")).alias("null_share"),
        "psi", "distance", "level")

"""Category unification: spellings of one label become its most frequent spelling.

Two labels of a column are spellings of each other if they agree without case, outer and repeated white space, or if in that
form they are one edit apart and both have ``LEAST_LENGTH`` characters. Edits are found by deletion neighbourhoods: a label
and each label with one character left out are keys, and two labels one edit apart share a key. Candidates are
verified by their Levenshtein distance and never paired up beyond one key's labels. Groups are connected
components; the most frequent spelling wins, the smallest of equally frequent ones.

Only distinct labels with their counts are joined, so hot labels cost one row a task; the number of keys of a
label is its length. Labels longer than ``MOST_LENGTH`` (texts, not categories) are unified by their plain form alone, and
labels that hold a digit too: codes that differ in one digit are different codes. Nulls stay null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.columns import STRING, column_ref, table_columns
from plumbline.operators.components import components
from plumbline.sources.staging import staged

LEAST_LENGTH = 5
MOST_LENGTH = 64


def plain_form(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def _keys(form: Column) -> Column:
    """The form itself and each form with one character left out."""
    shorter = F.transform(F.sequence(F.lit(1), F.char_length(form)), lambda i: F.concat(
        F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.char_length(form))))
    return F.array_distinct(F.concat(F.array(form), shorter))


def _links(forms: DataFrame) -> DataFrame:
    """Pairs of form numbers that are one edit apart."""
    joinable = F.char_length("form").between(LEAST_LENGTH, MOST_LENGTH) & ~F.col("form").rlike("[0-9]")
    keyed = forms.where(joinable).select("column", "number", "form", F.explode(_keys(F.col("form"))).alias("key"))
    left = keyed.select("column", "key", F.col("number").alias("a"), F.col("form").alias("x"))
    right = keyed.select("column", "key", F.col("number").alias("b"), F.col("form").alias("y"))
    met = left.join(right, ["column", "key"]).where("a < b").select("a", "b", "x", "y").distinct()
    return met.where(F.levenshtein("x", "y") <= 1).select("a", "b")


def label_map(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, label, n, unified) for every distinct label of the text columns, or of those named."""
    chosen = table_columns(df, STRING, names=columns)
    counted = reduce(DataFrame.unionByName, [
        df.where(c.ref.isNotNull()).groupBy(c.ref.cast("string").alias("label")).agg(F.count("*").alias("n")).select(F.lit(c.name).alias("column"), "label", "n")
        for c in chosen])
    labels = staged(counted.withColumn("form", plain_form(F.col("label"))), "labels")
    # Numbers are written before they are used, so a task that runs again can't change them.
    forms = staged(labels.select("column", "form").distinct().withColumn("number", F.monotonically_increasing_id()), "forms")
    found = components(_links(forms)).withColumnRenamed("node", "number")
    rooted = forms.join(found, "number", "left").select("column", "form", F.coalesce("root", "number").alias("root"))
    every = labels.join(rooted, ["column", "form"])
    best = every.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("less"), "label"))["label"].alias("unified"))
    return every.join(best, "root").select("column", "label", "n", "unified")


def unify_labels(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The table with every label replaced by the most frequent spelling of its group."""
    chosen = table_columns(df, STRING, names=columns)
    changes = staged(label_map(df, columns).where("label <> unified").select("column", "label", "unified"), "changes")
    for c in chosen:
        own = changes.where(F.col("column") == c.name).select(F.col("label").alias("__label"), F.col("unified").alias("__unified"))
        joined = df.join(own, c.ref == F.col("__label"), "left")
        df = joined.withColumn(c.name, F.coalesce("__unified", column_ref(c.name))).drop("__label", "__unified")
    return df

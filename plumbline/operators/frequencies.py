"""Distinct counts, value counts, top values and modes.

Columns are unpivoted to (column, value) rows and grouped, so one scan serves all
columns and every group is combined on the map side first: a value held by a third
of the rows arrives as one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.text import group_key
from plumbline.operators.columns import (
    BOOLEAN, DATETIME, NUMBER, STRING, TableColumn, cells, column_names, blocks, literal_table, table_columns,
)
from plumbline.sources.staging import staged


def _fixed_width_key(c: TableColumn) -> Column:
    # XXH64 of a single 8-byte value permutes the 64-bit numbers, so for these types
    # the hash is an exact key and one narrow column holds every type.
    if c.kind == DATETIME:
        value = c.ref.cast("timestamp")
    elif c.dtype in ("float", "double"):
        value = c.ref.cast("double")
    else:
        value = c.ref.cast("bigint")
    return F.when(c.ref.isNotNull(), F.xxhash64(value))


def _text_key(c: TableColumn) -> Column:
    if c.kind == STRING:
        return group_key(c.ref)
    if c.dtype.startswith("decimal"):
        return c.ref.cast("string")
    return group_key(c.cell)


def distinct_counts(df: DataFrame, columns: list[TableColumn] | None = None,
                    approx: bool = False) -> DataFrame:
    """(position, column, n_distinct), nulls not counted; exact unless ``approx``.

    ``approx`` takes a HyperLogLog count per column, without the large shuffle that
    nearly unique columns need.
    """
    columns = table_columns(df) if columns is None else columns
    columns = [c for c in columns if c.groupable]
    fixed = [c for c in columns if c.kind in (NUMBER, BOOLEAN, DATETIME) and not c.dtype.startswith("decimal")]
    other = [c for c in columns if c not in fixed]
    parts = []
    for group, key in ((fixed, _fixed_width_key), (other, _text_key)):
        for block in blocks(group):
            present = cells(df, block, key).where(F.col("value").isNotNull())
            if approx:
                parts.append(present.groupBy("slot").agg(F.approx_count_distinct("value", 0.01).alias("n")))
            else:
                parts.append(present.distinct().groupBy("slot").agg(F.count(F.lit(1)).alias("n")))
    names = column_names(df.sparkSession, columns)
    counted = reduce(DataFrame.unionByName, parts)
    return names.join(counted, "slot", "left").select(
        "position", "column", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_distinct"))


def value_counts(df: DataFrame, columns: list[TableColumn]) -> DataFrame:
    """(column, value, n): how often each non-null value occurs, values as text."""
    columns = [c for c in columns if c.groupable]
    counted = (cells(df, columns, lambda c: c.ref.cast("string")).where(F.col("value").isNotNull())
               .groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")))
    names = F.broadcast(column_names(df.sparkSession, columns).select("slot", "column"))
    return counted.join(names, "slot").select("column", "value", "n")


# Winners' keys that a filter may list; more are joined.
LISTED_KEYS = 2000
HEAD = 64


def _text(c: TableColumn) -> Column:
    return c.ref.cast("string")


def _key_counts(df: DataFrame, block: list[TableColumn]) -> DataFrame:
    """(slot, value, n): ``value`` is the text itself if short, else its first characters and its digest, so that no long text is
    shuffled and the order is that of the texts up to their first ``HEAD`` characters."""
    keyed = cells(df, block, lambda c: F.struct(F.substring(_text(c), 1, HEAD).alias("head"), F.when(
        F.octet_length(_text(c)) > HEAD, F.sha2(_text(c), 256)).alias("digest")))
    return keyed.where(F.col("value.head").isNotNull()).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))


def _with_texts(df: DataFrame, columns: list[TableColumn], winners: DataFrame) -> DataFrame:
    """Adds the whole text to the winners (slot, head, digest, n) as ``value``: one more scan, filtered to their digests."""
    short = winners.where("digest IS NULL").select("slot", "n", F.col("head").alias("value"))
    listed = [r.digest for r in winners.where("digest IS NOT NULL").select("digest").distinct().limit(LISTED_KEYS + 1).collect()]
    if not listed:
        return short
    long = cells(df, columns, lambda c: F.when(F.octet_length(_text(c)) > HEAD, _text(c)))
    marked = long.where(F.col("value").isNotNull()).withColumn("digest", F.sha2("value", 256))
    if len(listed) <= LISTED_KEYS:
        marked = marked.where(F.col("digest").isin(listed))
    else:
        marked = marked.join(winners.select("slot", "digest").distinct(), ["slot", "digest"], "left_semi")
    # Equal texts meet in their tasks first; only winners are left by now.
    texts = marked.groupBy("slot", "digest").agg(F.min("value").alias("value"))
    return short.unionByName(winners.join(texts, ["slot", "digest"]).select("slot", "n", "value"))


def top_values(df: DataFrame, columns: list[TableColumn], k: int) -> DataFrame:
    """(column, rank, value, n): the k most frequent values, ties by value.

    Long texts are counted by digest. The rank filter is applied per task before the shuffle, so a column with a billion values sends
    k rows a task, and only the winners' texts are fetched. Texts that tie up to their first characters are all fetched and ranked whole.
    """
    columns = [c for c in columns if c.groupable]
    found = []
    for block in blocks(columns):
        place = F.rank().over(Window.partitionBy("slot").orderBy(F.desc("n"), F.asc("value.head")))
        ranked = _key_counts(df, block).withColumn("place", place).where(F.col("place") <= k).select("slot", "value.head", "value.digest", "n")
        if any(c.kind not in (NUMBER, BOOLEAN, DATETIME) for c in block):
            found.append(_with_texts(df, block, staged(ranked, "winners")))
        else:
            found.append(ranked.select("slot", "n", F.col("head").alias("value")))
    order = Window.partitionBy("slot").orderBy(F.desc("n"), F.asc("value"))
    names = F.broadcast(column_names(df.sparkSession, columns).select("slot", "column"))
    return (reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(names, "slot").select("column", "rank", "value", "n"))


def modes(df: DataFrame, columns: list[TableColumn]) -> DataFrame:
    """(column, n_distinct, mode, n): the most frequent value, the smallest on a tie; columns without a value have no row.

    One grouped aggregate per block of columns, over the digests of long texts; texts are fetched for the winners alone.
    """
    columns = [c for c in columns if c.groupable]
    names = {c.slot: c.name for c in columns}
    found, open_ = [], []
    for block in blocks(columns):
        # One aggregate per column and no grouping: text in a grouped aggregate would force a sort of the whole count table.
        aggregates = []
        for c in block:
            mine = F.col("slot") == F.lit(c.slot)
            best = F.min(F.when(mine, F.struct((-F.col("n")).alias("least"), F.col("value.head").alias("head"), F.col("value.digest").alias("digest"))))
            aggregates += [best.alias(f"best_{c.slot}"), F.count_if(mine).alias(f"n_{c.slot}")]
        row = _key_counts(df, block).agg(*aggregates).first()
        for c in block:
            best, n = row[f"best_{c.slot}"], row[f"n_{c.slot}"]
            if n and best.digest is None:
                found.append((c.slot, n, best.head, -best.least))
            elif n:
                open_.append((c, n, best))
    for block in blocks(open_):
        mine = [c for c, _, _ in block]
        tied = reduce(lambda a, b: a | b, [(F.col("slot") == c.slot) & (F.col("n") == -best.least) & (F.col("value.head") == best.head) for c, _, best in block])
        winners = staged(_key_counts(df, mine).where(tied).select("slot", "value.head", "value.digest", "n"), "winners")
        smallest = {r.slot: r.value for r in _with_texts(df, mine, winners).groupBy("slot").agg(F.min("value").alias("value")).collect()}
        found += [(c.slot, n, smallest[c.slot], -best.least) for c, n, best in block]
    return literal_table(df.sparkSession, [(names[slot], n, mode, times) for slot, n, mode, times in found], "column string, n_distinct bigint, mode string, n bigint")

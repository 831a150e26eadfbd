"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys are cut into equal ranges, as many for each source as
its number of documents asks for, so a range holds about ``RANGE_ROWS`` rows whatever the source's
share is. Within a range rows are sorted by key and summed up; the ranges' totals, summed up per
source, give each range its offset. So every document knows the number of its source's words
before it, and the mix takes whole passes over the source, then its words up to the exact budget:
the document at the cut is taken in part.

Targets: a share of all words is split by weight; a source stops at ``most`` times its size and
the excess goes to the others by weight. That is one water level: the largest
(words left) / (weights left) along the sources ordered by size per weight.

Defined cases: a null text has size 0; a null source is a source of its own and comes last. A
document of size 0 takes 0 words. Rows that agree in everything are interchangeable. An empty table
gives no rows. Memory: one range; the table of sources is sorted in one task, a row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import column_or_null, split_words, staged, whole_row, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
RANGE_ROWS = 4096


def _sizes(docs: DataFrame, row: Column, id_: Column, text: Column, source: Column) -> DataFrame:
    return docs.select(row.alias("row"), id_.alias("id"), source.alias("source"), word_count(text).alias("size"), _key(id_, text).alias("key"))


def _key(id_: Column, text: Column) -> Column:
    """A hash-random number of 60 bits."""
    digest = F.md5(F.concat_ws(" ", id_.cast("string"), text))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, number (by code point, null last), documents, source_size and target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    numbered = totals.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = (numbered.withColumn("weight", F.element_at(cycle, F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1))
               .withColumn("most", F.col("source_size") * most))
    order = Window.orderBy((F.col("most") / F.col("weight")), "number")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighed.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - before) / left)
    return level.select("source", "number", "documents", "source_size",
                        F.least(F.col("most").cast("double"), F.max("level").over(whole) * F.col("weight")).alias("target"))


def _taken(sizes: DataFrame, goal: DataFrame, range_rows: int) -> DataFrame:
    ranges = F.greatest(F.lit(1), F.ceil(F.col("documents") / F.lit(float(range_rows)))).cast("long")
    placed = (sizes.join(goal, sizes["source"].eqNullSafe(goal["source"]))
              .select("row", "id", "size", "key", "number", "source_size", "target",
                      F.shiftright(F.shiftright("key", 28) * ranges, 32).alias("range")))
    totals = placed.groupBy("number", "range").agg(F.sum("size").alias("words"))
    offsets = totals.select("number", "range", F.coalesce(F.sum("words").over(
        Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("number", "range").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["number", "range"])
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size") - F.col("inside") - F.col("offset")
    return summed.select("row", "id", "size", "source_size", "target",
                         (passes * F.col("size") + F.least(F.col("size"), F.greatest(rest, F.lit(0)))).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
          id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: id, size, source_size, target and taken (words, repeats counted)."""
    source = column_or_null(docs, source_column, "string")
    sizes = staged(_sizes(docs, F.lit(0), docs[id_column], docs[text_column], source), "sizes")
    goal = staged(targets(sizes, weights, share, most), "targets")
    return _taken(sizes, goal, range_rows).drop("row")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
        id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        length_column: str = "n_chars", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass over a document. The text at a
    source's cut ends with the last word taken (its words joined by spaces, its length renewed). Rows are
    numbered and written before they are planned, so every row keeps its own columns, whatever its id and text."""
    numbered = staged(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("number")), "numbered")
    row = F.col("row")
    source = row[source_column] if source_column in docs.columns else F.lit(None).cast("string")
    sizes = staged(_sizes(numbered, F.col("number"), row[id_column], row[text_column], source), "sizes")
    goal = staged(targets(sizes, weights, share, most), "targets")
    plan = _taken(sizes, goal, range_rows).where("taken > 0").select(F.col("row").alias("number"), "size", "taken")
    passes = numbered.join(plan, "number").select("row", "size", "taken", F.explode(F.expr("sequence(0L, (taken - 1) div size)")).alias("pass"))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    whole = words == F.col("size")
    text = F.when(whole, row[text_column]).otherwise(F.array_join(F.slice(split_words(row[text_column]), F.lit(1), words.cast("int")), " "))
    found = {text_column: text}
    if length_column in docs.columns:
        found[length_column] = F.when(whole, row[length_column]).otherwise(F.char_length(text).cast(docs.schema[length_column].dataType))
    return passes.select(*[found.get(c, row[c]).alias(c) for c in docs.columns])

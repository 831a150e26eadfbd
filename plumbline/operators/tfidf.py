"""TF-IDF vectors of a text column, with the vocabulary as a distributed table.

A vector is a pair of arrays: indices into the vocabulary, ascending, and weights of length 1 in total. A weight is the
term's frequency times ln((1 + documents) / (1 + documents with the term)) + 1. The index of a term is its rank in code-point order,
made by a range sort and the offsets of its ranges, so no task and no driver holds the vocabulary.

Terms are counted in the tasks first: a document and term is one row. Joining these with the vocabulary would bring a
term of every text to one task; a term in more than one of ``HOT`` documents is therefore joined by broadcast, of which there are at most
``HOT`` times the mean number of distinct terms of a document, and every other one is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.operators.columns import column_ref
from plumbline.sources.staging import staged

HOT = 1000
# Words of letters and digits, in lower case.
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): one row per document and term; rows with one key are one document."""
    return df.select(column_ref(key).alias("key"), F.explode(terms(column_ref(text))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, df, index): index is the rank of the term, from 0."""
    listed = counts.groupBy("term").agg(F.count("*").alias("df"))
    placed = staged(listed.repartitionByRange("term").sortWithinPartitions("term").select(
        "term", "df", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "vocabulary")
    # Places are consecutive within a part; the sizes of the parts give each part its offset.
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    offsets = sizes.select("part", "first", (F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").select("term", "df", (F.col("offset") + F.col("place") - F.col("first")).alias("index"))


def tfidf(df: DataFrame, key: str, text: str, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The vectors (key, indices, weights) of the documents with a term, and the vocabulary (term, df, index)."""
    counts = staged(term_counts(df, key, text), "term_counts")
    known = staged(vocabulary(counts), "vocabulary")
    documents = counts.select("key").distinct().count()
    weighed = known.select("term", "index", "df", (F.log(F.lit(1.0 + documents) / (F.col("df") + 1)) + 1).alias("idf"))
    limit = documents / hot
    often = F.broadcast(weighed.where(F.col("df") > limit).drop("df"))  # at most ``hot`` x the mean number of terms of a document
    rest = weighed.where(F.col("df") <= limit).drop("df")
    marked = counts.join(often, "term", "left")
    cells = marked.where("idf IS NOT NULL").unionByName(marked.where("idf IS NULL").drop("index", "idf").join(rest, "term").select(*marked.columns))
    vectors = cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("index", (F.col("tf") * F.col("idf")).alias("w")))).alias("x"))
    squares = F.aggregate("x", F.lit(0.0), lambda a, e: a + e["w"] * e["w"])
    # The array of one norm binds it: inside the inner lambda alone it would be summed again for every term.
    weights = F.flatten(F.transform(F.array(F.sqrt(squares)), lambda norm: F.transform("x", lambda e: e["w"] / norm)))
    return vectors.select(F.col("key").alias(key), F.col("x.index").alias("indices"), weights.alias("weights")), known

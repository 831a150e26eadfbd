"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A normalised text is cut into fixed-size blocks of bytes. All distinct blocks are sorted and
numbered; then adjacent names are paired, the distinct pairs sorted and numbered again, until
one name is left. Two texts have the same identity (number of rounds, name) exactly if they
are equal: a name stands for one block or one pair, so no hash decides.

Block contents are shuffled once, after equal blocks have been merged in the map tasks. Block
occurrences refer to contents by a 128-bit signature that is *proven* to be one-to-one for the
blocks at hand: the named blocks are counted by signature, and another seed is taken if two
contents share one.

Numbers are given within sorted partitions and written to the staging folder before they are
used, so a task that runs again can't change them.

Defined cases: a null text counts as empty, empty texts are equal to each other and to texts of
white space only. Of rows that agree in text and id one stays. A null id is larger than any other
and stays only if all ids of its group are null. An empty table gives no rows. Other columns are
neither read nor renamed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, drop_staged, staged, staged_path, whole_row

BLOCK_BYTES = 4096
_SEEDS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _blocks(data: Column, size: int) -> Column:
    """The bytes in blocks of ``size``; one empty block where there are none."""
    last = F.greatest(F.octet_length(data) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.floor(last / size).cast("int")),
                       lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _signature(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(block, F.lit(2 * seed)).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b"))


def _numbered(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct rows with integer names, given in sorted order within each partition."""
    return staged(distinct.sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("name")), name)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].alias("id"), normalised(docs[text_column]).alias("text"))


def _named_blocks(texts: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """One row per document with its signatures, and the name of each signature."""
    spark = texts.sparkSession
    blocks = _blocks(F.col("text").cast("binary"), block_bytes)
    for seed in range(_SEEDS):
        distinct = (texts.select(F.explode(blocks).alias("block"))
                    .select(_signature(F.col("block"), seed).alias("signature"), "block")
                    .distinct())
        path = staged_path(spark, "names")
        (distinct.sortWithinPartitions("block").select("signature", F.monotonically_increasing_id().alias("name"))
         .write.parquet(path))
        names = spark.read.parquet(path)
        if names.groupBy("signature").count().where("count > 1").isEmpty():
            documents = staged(texts.select(
                F.monotonically_increasing_id().alias("row"), "id", F.sha2(F.col("text"), 256).alias("sha"),
                F.transform(blocks, lambda b: _signature(b, seed)).alias("signatures")), "documents")
            return documents, names
        drop_staged(spark, path)
    raise RuntimeError("no seed gives every block a signature of its own")


def _gathered(parts: DataFrame) -> DataFrame:
    """The names of each row in order; a row's names are never longer than its text."""
    return parts.groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


def identities(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: row, id, sha, and its identity (round, name). ``row`` is unique."""
    documents, names = _named_blocks(_texts(docs, id_column, text_column), block_bytes)
    parts = documents.select("row", F.posexplode("signatures").alias("pos", "signature"))
    open_rows = staged(_gathered(parts.join(names, "signature")), "round0")
    longest = open_rows.agg(F.max(F.size("names"))).first()[0] or 1
    done = []
    for step in range((longest - 1).bit_length() + 1):
        done.append(open_rows.where(F.size("names") == 1)
                    .select("row", F.lit(step).alias("round"), F.col("names")[0].alias("name")))
        if step == (longest - 1).bit_length():
            break
        # (left, right) of each pair; -1, which is no name, stands where the last has no partner.
        pairs = staged(open_rows.where(F.size("names") > 1).select("row", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.get("names", i * 2).alias("left"),
                               F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("right")))).alias("pos", "pair"))
            .select("row", "pos", "pair.left", "pair.right"), "pairs")
        pair_names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"], "pair_names")
        open_rows = staged(_gathered(pairs.join(pair_names, ["left", "right"])), f"round{step + 1}")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return documents.select("row", "id", "sha").join(found, "row")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256."""
    known = staged(identities(docs, id_column, text_column, block_bytes), "identities")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    groups = staged(known.groupBy("round", "name").agg(F.min(order).alias("first"), F.count("*").alias("size"))
                    .where("size > 1"), "groups")
    found = known.join(groups, ["round", "name"], "left")
    return found.select(
        F.col("id").alias(id_column),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without exact copies, with all their columns."""
    groups = staged(exact_groups(docs, id_column, text_column, block_bytes), "exact_groups")
    return kept_documents(docs, groups, id_column, F.sha2(normalised(docs[text_column]), 256))


def kept_documents(docs: DataFrame, decisions: DataFrame, id_column: str, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose decision says kept. Rows that agree in id and digest share decisions;
    as many of them stay as there are kept decisions, which is one or none."""
    keys = [F.col(id_column).alias("id"), F.col("text_sha256").alias("sha")]
    verdicts = decisions.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("kept")
    verdicts = staged(verdicts, "verdicts")
    # The row travels as one struct, so no name of its columns can clash.
    marked = docs.select(whole_row(docs), docs[id_column].alias("own_id"), digest.alias("own_sha"))
    found = marked.join(verdicts, marked["own_id"].eqNullSafe(verdicts["id"]) & (marked["own_sha"] == verdicts["sha"]))
    if not verdicts.where("rows > 1").isEmpty():
        found = found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["own_id", "own_sha"]))
    return found.select("row.*")

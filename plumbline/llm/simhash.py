"""Near duplicates by SimHash with meet-in-the-middle ball hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 values (seed 42) of
the text's word shingles. Two fingerprints are linked if at most ``radius`` bits differ. Each
distinct fingerprint emits every variant within half the radius (65 of them for radius 2);
linked fingerprints share a variant, and two that share one differ in ``radius`` bits at most.
A variant is shared by no more fingerprints than there are variants, so no bucket grows with the
data, and exact copies never meet: they have one fingerprint.

Within a bucket, neighbours in sorted order are linked, which keeps every component whole
without writing all pairs; ``linked_pairs`` writes them all. Components come from alternating
large and small stars. Every round is written to the staging folder.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle. Repeated rows and
ids are fine. A component has a null id only if all its ids are null. An empty table gives no
rows. Other columns are neither read nor renamed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import by_value, map_batches, staged
from plumbline.llm.naming import kept_documents

SHINGLE_WORDS = 3
RADIUS = 2
_SEED = 42
_BITS = 64
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = [digest(joined[s:e], _SEED) for s, e in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """id and fp (the fingerprint as a signed long), one row per document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x, shingle_words) for x in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])
    texts = docs.select(docs[id_column].alias("id"), F.coalesce(docs[text_column], F.lit("")).cast("binary").alias("text"))
    return map_batches(texts, run, f"id {docs.schema[id_column].dataType.simpleString()}, fp long")


def _variants(fp: Column, radius: int) -> Column:
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(_BITS), n)]
    signed = [m - (1 << _BITS) if m >> (_BITS - 1) else m for m in masks]
    return F.explode(F.array(*[fp.bitwiseXOR(F.lit(m).cast("long")) for m in signed]))


def _close(radius: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified pairs a < b of the fingerprints in column fp that hold each component together."""
    emitted = distinct.select("fp", _variants(F.col("fp"), radius).alias("variant"))
    neighbours = emitted.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    return neighbours.where("a IS NOT NULL").distinct().where(_close(radius))


def linked_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs a < b of distinct fingerprints in column fp that differ in ``radius`` bits at most."""
    emitted = distinct.select("fp", _variants(F.col("fp"), radius).alias("variant"))
    left, right = emitted.withColumnRenamed("fp", "a"), emitted.withColumnRenamed("fp", "b")
    return left.join(right, "variant").where("a < b").select("a", "b").distinct().where(_close(radius))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (a, b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = staged(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large")
    down = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(down, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return staged(small.unionByName(down.select(F.col("m").alias("a"), "b")).where("a < b").distinct(), "small")


def components(edges: DataFrame) -> DataFrame:
    """root and fp for every fingerprint with a link; the root is the smallest of its component."""
    edges, before = staged(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("root"), F.col("b").alias("fp"))
        edges, before = _stars(edges), state


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id."""
    known = staged(fingerprints(docs, id_column, text_column, shingle_words), "fingerprints")
    distinct = staged(known.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = staged(components(links(distinct, radius)), "components")
    rooted = staged(distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fingerprint = staged(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "by_fingerprint")
    return known.join(by_fingerprint, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component with all its columns: the one with the smallest id (null last), of equal ids the one
    with the smallest digest of its text. Rows are judged one by one, so rows that share an id without being near copies all stay."""
    digest = F.sha2(F.coalesce(docs[text_column], F.lit("")), 256)
    own = F.struct(docs[id_column].isNull().alias("last"), docs[id_column].alias("id"), digest.alias("sha"))
    groups = near_groups(docs.select(own.alias("own"), docs[text_column].alias("text")), "own", "text", shingle_words, radius)
    decisions = groups.select(F.col("own.id").alias(id_column), F.col("own.sha").alias("text_sha256"), (F.col("own") == F.col("component_id")).alias("kept"))
    return kept_documents(docs, staged(decisions, "near_decisions"), id_column, digest)


by_value(__name__)

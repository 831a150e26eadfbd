"""Suffix-array dedup with a run-length index: removes bytes of long strings that occur earlier.

A string of ``length`` bytes is removed where it starts if it also starts earlier: in a document of smaller
id, or earlier in the same one. Every such string has one anchor, the smallest hash of its ``GRAM``-byte
grams (the leftmost of equal ones), so equal strings have equal anchors at the same offset:

1. Each text is cut into the stretches of strings that share an anchor. Equal texts meet by digest: all but the
   first are removed whole. Of the rest, only anchors that two texts share, or that a text has twice, can
   hold a repeat. (Texts are told apart by hash here: a wrong "equal" would take two different texts that share a
   passage and agree in 64 bits, and no third one.)
2. For these, the stretches (about 135 bytes) are read. Equal stretches meet by digest with the least
   position kept, before the shuffle; all but the first are removed whole.
3. Different stretches with one anchor are dealt to shards by anchor. A shard is the text of a run-length
   index: the suffixes at which whole strings start are sorted, by prefix doubling and then in steps; their
   Burrows-Wheeler transform is compressed to runs, and matching lengths are kept at run ends only. Streaming over the text, the match of each place follows from the
   last run end (its length less the bytes since). Matches of ``length`` or more form classes; all but the first
   place of a class are removed.
4. An anchor with more different stretches than a shard holds goes another way: all its strings meet by
   digest with the least position kept. So no group meets in one task.

Defined cases: a null text counts as empty. Null ids come first. Rows that agree in the id are one document to
each other: neither is earlier, unless their texts differ (then text hash orders them). Texts shorter than
``length`` stay whole. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_value, drop_staged, map_batches, packed, release, staged

LENGTH = 100
GRAM = 32
SHARD_STRETCHES = 12_000
LARGE_GROUP = 12_000
_PIECE = 1 << 18
_PLACE_BITS = np.uint64(20)
_BASE = 0x9E3779B97F4A7C15


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of a text: the hash of their anchor, its place, and the first start of a string with this anchor.

    A start goes on to the next stretch's first start; the last one ends at len(text) - length + 1."""
    starts = len(text) - length + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [_anchors_of_piece(text[at:min(at + _PIECE, starts) + length - 1], length, gram, at) for at in range(0, starts, _PIECE)]
    hashes, places, first = (np.concatenate(x) for x in zip(*found))
    new = np.concatenate(([True], places[1:] != places[:-1]))  # pieces may share an anchor
    return hashes[new], places[new], first[new]


def _anchors_of_piece(text: bytes, length: int, gram: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    window = length - gram + 1
    value = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    have, power, total, total_have = 1, _BASE, None, 0
    todo = gram
    while todo:  # polynomial hash of grams by doubling
        if todo & 1:
            if total is None:
                total, total_have = value, have
            else:
                size = len(total) - have
                total = total[:size] * np.uint64(pow(_BASE, have, 1 << 64)) + value[total_have:total_have + size]
                total_have += have
        todo >>= 1
        if todo:
            value = value[:-have] * np.uint64(power) + value[have:]
            power = power * power % (1 << 64)
            have *= 2
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    key = (total & ~((np.uint64(1) << _PLACE_BITS) - np.uint64(1))) | np.arange(len(total), dtype=np.uint64)
    least, width = key, 1
    while width * 2 <= window:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < window:
        least = np.minimum(least[:-(window - width)], least[window - width:])
    place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    at = place[first]
    return total[at].view(np.int64), at + offset, first + offset


def _rank(keys: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(keys)
    step = np.empty(len(keys), np.int64)
    step[0] = 0
    np.cumsum(keys[order[1:]] != keys[order[:-1]], out=step[1:])
    rank = np.empty(len(keys), np.int64)
    rank[order] = step
    return rank, int(step[-1]) + 1


def run_length_index(stretches: list[bytes], length: int) -> np.ndarray:
    """For every byte of the stretches, joined with a separator after each: whether the string of ``length`` bytes
    from there on also starts earlier."""
    size = np.fromiter(map(len, stretches), np.int64, len(stretches))
    ends = np.cumsum(size + 1)
    n = int(ends[-1])
    symbols = np.zeros(n, np.int64)
    symbols[np.arange(n - len(stretches)) + np.repeat(np.arange(len(stretches)), size)] = (
        np.frombuffer(b"".join(stretches), np.uint8).astype(np.int64) + 1)
    left = np.repeat(ends - 1, size + 1) - np.arange(n)  # bytes up to the separator

    def ahead(values: np.ndarray, step: int) -> np.ndarray:
        """What stands ``step`` bytes further on, in the same stretch; else 0."""
        found = np.zeros(n, np.int64)
        found[:n - step] = values[step:]
        return np.where(left >= step, found, 0)

    # Ranks by the first 28 bytes, by prefix doubling. A suffix ends at its separator.
    key, width = np.zeros(n, np.int64), 7
    for j in range(width):
        key = (key << 9) | ahead(symbols, j)
    rank, _ = _rank(key)
    while width < 28:
        rank, _ = _rank(rank * (n + 1) + ahead(rank + 1, width))
        width *= 2
    # Only where a string of the length starts does a suffix count; these are sorted to their ends, in steps of the ranks.
    # Separators are ordered by their place. (The byte after a stretch's last start is left out: a match
    # followed there from the start before is shorter than the length either way.)
    starts = np.flatnonzero(left >= length)
    order = rank[starts]
    for step in range(width, int(size.max()) + 1, width):
        order, _ = _rank(order * (n + 1) + ahead(rank + 1, step)[starts])
    m = len(starts)
    if not m:
        return np.zeros(n, bool)
    by_order = np.argsort(order * m + np.arange(m))
    suffixes = starts[by_order]
    # Runs of the transform; a place where a stretch begins has no byte before it and is a run by itself.
    before = np.where(suffixes > 0, symbols[suffixes - 1], 0)
    head = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))
    # Samples: at each run's first suffix, the length it shares with the suffix that ends the run above.
    heads = np.flatnonzero(head)
    here, above = suffixes[heads], suffixes[np.maximum(heads - 1, 0)]
    shared = np.zeros(len(heads), np.int64)
    active = np.flatnonzero(heads > 0)
    reach = 0
    while len(active):
        a, b = here[active] + reach, above[active] + reach
        same = (symbols[a] == symbols[b]) & (symbols[a] > 0)
        active = active[same]
        shared[active] += 1
        reach += 1
    # Stream over the text: within a run's reach the match loses one byte a step.
    in_text = np.argsort(here)
    last = np.searchsorted(here[in_text], starts, side="right") - 1
    match = shared[in_text][last] - (starts - here[in_text][last])
    begin = np.flatnonzero(match[by_order] < length)
    first = np.minimum.reduceat(suffixes, begin)
    earlier = np.zeros(n, bool)
    earlier[suffixes] = np.repeat(first, np.diff(np.append(begin, m))) < suffixes
    return earlier


def _shard_spans(rows: pa.Table, length: int) -> pa.Table:
    """Maximal spans, per stretch, of strings that also start earlier in the shard."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("id", "text_hash", "first")], null_placement="at_start"))
    stretches = rows["stretch"].to_pylist()
    earlier = run_length_index(stretches, length)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], earlier.astype(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    base = np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches)) + 1)
    owner = np.searchsorted(base, begin, side="right")
    shift = rows["first"].to_numpy()[owner] - np.concatenate(([0], base[:-1]))[owner]
    found = rows.select(["id", "text_hash"]).take(pa.array(owner))
    return found.append_column("start", pa.array(begin + shift)).append_column("stop", pa.array(end - 1 + shift + length))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(docs[text_column], F.lit("")).cast("binary")
    return docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _same_document(left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
    """The right side with other key names, and the condition that its document is the left one."""
    right = right.withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    return right, left["id"].eqNullSafe(right["_id"]) & (left["text_hash"] == right["_hash"])


def _anchor_lists(texts: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, once, again = batch.column(2).to_pylist(), [], []
        for text in texts:
            values, counts = np.unique(anchors(text, length, gram)[0], return_counts=True)
            once.append(values)
            again.append(values[counts > 1])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(x) for x in texts], pa.int64()),
             pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()), _lists(once), _lists(again)],
            ["id", "text_hash", "size", "digest", "anchors", "again"])
    return map_batches(texts, run, f"id {kind}, text_hash long, size long, digest binary, anchors array<long>, again array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def _copies(listed: DataFrame) -> DataFrame:
    """The documents whose whole text stands in an earlier one: id, text_hash and size."""
    first = listed.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("least"), F.count("*").alias("n")).where("n > 1")
    first = staged(first.select("digest", "least"), "first_copies")
    return staged(listed.select("id", "text_hash", "size", "digest").join(first, "digest").where("NOT (struct(id, text_hash) <=> least)")
                  .select("id", "text_hash", "size"), "copies")


def _read_stretches(texts: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """The stretches of the anchors in column ``held``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, numbers, digests, stretches = [], [], [], []
        for at, (text, held) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
            hashes, places, first = anchors(text, length, gram)
            stop = np.append(first[1:], len(text) - length + 1) + length - 1
            kept = np.flatnonzero(np.isin(hashes, held.values.to_numpy()))
            numbers.append(np.stack((hashes[kept], places[kept] - first[kept], first[kept])))
            owner.append(np.full(len(kept), at, np.int32))
            own = [text[a:b] for a, b in zip(first[kept].tolist(), stop[kept].tolist())]
            digests += [hashlib.md5(x).digest() for x in own]
            stretches += own
        taken = pa.array(np.concatenate(owner))
        anchor, lead, start = np.concatenate(numbers, axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(anchor), pa.array(lead), pa.array(start),
             pa.array(digests, pa.binary()), pa.array(stretches, pa.binary())],
            ["id", "text_hash", "anchor", "lead", "first", "digest", "stretch"])
    found = map_batches(texts, run, f"id {kind}, text_hash long, anchor long, lead long, first long, digest binary, stretch binary")
    return found.withColumn("size", F.octet_length("stretch"))


def _in_large_groups(stretches: DataFrame, length: int) -> DataFrame:
    """Spans of strings that start earlier, for anchors with too many stretches for a shard."""
    starts = stretches.select("id", "text_hash", F.explode(F.transform(
        F.sequence(F.lit(0), F.octet_length("stretch") - length),
        lambda i: F.struct((F.col("first") + i).alias("start"), F.unhex(F.md5(F.substring(F.col("stretch"), i + 1, F.lit(length)))).alias("string")))).alias("x"))
    starts = staged(starts.select("id", "text_hash", "x.start", "x.string"), "strings")
    least = staged(starts.groupBy("string").agg(F.min(F.struct("id", "text_hash", "start")).alias("least"), F.count("*").alias("n"))
                   .where("n > 1").select("string", "least"), "least_strings")
    again = starts.join(least, "string").where("NOT (struct(id, text_hash, start) <=> least)")
    return again.select("id", "text_hash", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM,
                   shard_stretches: int = SHARD_STRETCHES, large_group: int = LARGE_GROUP) -> DataFrame:
    """id, text_hash, start and stop (bytes) of spans to be removed; they may overlap."""
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    texts = _keyed(docs, id_column, text_column)
    listed, listed_path = packed(_anchor_lists(texts, kind, length, gram), "anchors")
    copies = _copies(listed)
    single = (listed.select(F.explode("anchors").alias("anchor"), "text_hash", F.lit(False).alias("twice"))
              .unionByName(listed.select(F.explode("again").alias("anchor"), "text_hash", F.lit(True).alias("twice"))))
    counted = single.groupBy("anchor").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.max("twice").alias("twice"))
    repeated, repeated_path = packed(counted.where("a < b OR twice").select("anchor"), "repeated")
    release(spark)
    placed = listed.select("id", "text_hash", F.explode("anchors").alias("anchor")).join(repeated, "anchor")
    held = placed.groupBy("id", "text_hash").agg(F.collect_set("anchor").alias("held"))
    right, same = _same_document(held, copies)
    held, held_path = packed(held.join(right, same, "left_anti"), "held")
    drop_staged(spark, listed_path, repeated_path)
    right, same = _same_document(texts, held)
    stretches, _ = packed(_read_stretches(texts.join(right, same).select("id", "text_hash", "text", "held"), kind, length, gram), "stretches")
    drop_staged(spark, held_path)
    distinct, _ = packed(stretches.groupBy("anchor", "lead", "digest").agg(F.min(F.struct("id", "text_hash", "first", "stretch")).alias("least"))
                         .select("anchor", "lead", "digest", "least.*"), "distinct")
    release(spark)
    heads = distinct.select("anchor", "lead", "digest", F.struct("id", "text_hash", "first").alias("least"))
    others = (stretches.select("id", "text_hash", "anchor", "lead", "digest", "first", "size").join(heads, ["anchor", "lead", "digest"])
              .where("NOT (struct(id, text_hash, first) <=> least)")
              .select("id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop")))
    varied = staged(distinct.groupBy("anchor").agg(F.count("*").alias("stretches")).where("stretches > 1"), "varied")
    total, largest = varied.agg(F.coalesce(F.sum("stretches"), F.lit(0)), F.max("stretches")).first()
    shards = max(1, math.ceil(total / shard_stretches))
    several = distinct.join(varied, "anchor")
    found = (several.where(F.col("stretches") <= large_group)
             .select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "id", "text_hash", "first", "stretch")
             .groupBy("shard").applyInArrow(lambda rows: _shard_spans(rows, length), f"id {kind}, text_hash long, start long, stop long"))
    whole = copies.where(F.col("size") >= length).select("id", "text_hash", F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))
    spans = whole.unionByName(others).unionByName(found)
    if (largest or 0) > large_group:
        spans = spans.unionByName(_in_large_groups(several.where(F.col("stretches") > large_group), length))
    return spans


def merged_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the spans cover."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))[:len(start)]
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)[:new.sum()]]


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
                    **settings: int) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans and kept (the bytes left, which may cut a character)."""
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    spans = repeated_spans(docs, id_column, text_column, length, **settings)
    marks = staged(spans.groupBy("id", "text_hash").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop")), "marks")
    release(spark)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, count, kept = [], [], []
        texts = batch.column(1).to_pylist()
        for text, begin, end in zip(texts, batch.column(2), batch.column(3)):
            if not begin.is_valid:
                removed.append(0), count.append(0), kept.append(text)
                continue
            start, stop = merged_spans(begin.values.to_numpy(), end.values.to_numpy())
            removed.append(int((stop - start).sum())), count.append(len(start))
            kept.append(b"".join(text[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(text)])))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, pa.int64()) for x in (list(map(len, texts)), removed, count)], pa.array(kept, pa.binary())],
            [id_column, "n_bytes", "n_removed", "n_spans", "kept"])
    texts = _keyed(docs, id_column, text_column)
    right, same = _same_document(texts, marks)
    return map_batches(texts.join(right, same, "left").select("id", "text", "start", "stop"), run,
                       f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


by_value(__name__)

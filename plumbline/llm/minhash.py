"""Near duplicates by MinHash: universal hash minima, banding, signature check, exact check, components.

A text's set holds the hashes of its distinct four-word shingles. A signature has ``BANDS`` x ``ROWS`` minima
of universal hash functions a * x + b. Texts that agree in all rows of one band share a bucket: at similarity
0.8 a pair misses every bucket with probability (1 - 0.8 ** 5) ** 40 = 1.3e-7, and less above. A pair of a
bucket is first checked on its signatures (a pair at 0.8 fails that with probability below 1e-10), then on
its full sets. Components come from alternating large and small stars.

Pairs of a bucket are never all written. Texts with equal sets are one node. First every node of a bucket
meets the bucket's lead, the node whose buckets are the fullest: of a family of copies that is the one nearest to
the rest. The links found make components, and only nodes whose bucket holds *different* components are left, say
pages in one frame that are alike without being near copies. These are joined exactly by their rarest shingles: with
shingles ordered by frequency, the first one that a linked pair shares is among the |x| - c + 1 first ones
of both, where c = 4/9 (|x| + |y|) is what they share at least. What makes a page differ comes first in that order, so
pages that share no more than a frame don't meet, and no bucket is cut short.

Defined cases: a null text counts as empty; a text without words has an empty set and is linked with nothing,
its own copies included; a text of one to three words is one shingle. Repeated rows and ids are fine. A
component has a null id only if all its ids are null; of rows that share the smallest id all are kept.
An empty table gives no rows. Other columns are neither read nor renamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_value, map_batches, staged
from plumbline.llm.simhash import components

SHINGLE_WORDS = 4
BANDS = 40
ROWS = 5
# Of 200 minima a pair at similarity 0.8 shares 160 on average, with a deviation of 5.7.
LEAST_SHARED = 120
_SEED = 42
_CHUNK = 1 << 15
_KNOWN_WORDS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TIMES, _PLUS = np.random.default_rng(_SEED).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint64).astype(np.uint32)
_TIMES |= np.uint32(1)


class _Words(dict):
    """The hash of each word met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, _SEED)
        return found


def _mixed(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ word) * _STEP
    return hashes ^ (hashes >> np.uint64(29))


def shingle_sets(texts: list[bytes], known: dict | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each UTF-8 text."""
    known = _Words() if known is None else known
    split = [t.lower().split() for t in texts]
    length = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(length.sum()))
    size = max(len(words) - SHINGLE_WORDS + 1, 0)
    hashes = np.full(size, _SEED, np.uint64)
    for k in range(SHINGLE_WORDS):
        hashes = _mixed(hashes, words[k:k + size])
    found = []
    for end, n in zip(np.cumsum(length).tolist(), length.tolist()):
        if n >= SHINGLE_WORDS:
            found.append(np.unique(hashes[end - n:end - SHINGLE_WORDS + 1]))
        else:
            whole = np.full(min(n, 1), _SEED, np.uint64)
            for k in range(end - n, end):
                whole = _mixed(whole, words[k:k + 1])
            found.append(whole)
    return found


def _pieces(sets: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Sets that aren't empty, cut into pieces, some ``_CHUNK`` hashes at a time."""
    owners, parts, size = [], [], 0
    for n, values in enumerate(sets):
        for at in range(0, len(values), _CHUNK):
            owners.append(n)
            parts.append(values[at:at + _CHUNK])
            size += len(parts[-1])
            if size >= _CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if owners:
        yield owners, parts


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each set, one row a set; all ones for an empty set."""
    least = np.full((len(sets), BANDS * ROWS), np.iinfo(np.uint32).max, np.uint32)
    for owners, parts in _pieces(sets):
        values = (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(length) - length
        held, minima = np.empty_like(values), np.empty((BANDS * ROWS, len(parts)), np.uint32)
        for k in range(BANDS * ROWS):
            np.multiply(values, _TIMES[k], out=held)
            np.add(held, _PLUS[k], out=held)
            np.minimum.reduceat(held, start, out=minima[k])
        # Pieces of one set follow each other; only a set cut in two occurs twice.
        for column, owner in enumerate(owners):
            np.minimum(least[owner], minima[:, column], out=least[owner])
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of each signature."""
    rows = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        keys = _mixed(keys, rows[:, :, k])
    return keys


def short_signatures(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum."""
    return (least ^ (least >> np.uint32(8))).astype(np.uint8)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def _sketches(texts: DataFrame, id_kind: str) -> DataFrame:
    """id, key1, key2 (hashes of the text), n, digest (of the set), low (short signature) and bands of every row."""
    known = _Words()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(3).to_pylist(), known)
        least = signatures(sets)
        empty = np.array([len(x) == 0 for x in sets], bool)
        keys = [k[:0] if e else k for k, e in zip(band_keys(least), empty)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([len(x) for x in sets], pa.int64()),
             pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
             pa.array([x.tobytes() for x in short_signatures(least)], pa.binary()), _lists(keys)],
            ["id", "key1", "key2", "n", "digest", "low", "bands"])
    return map_batches(texts, run, f"id {id_kind}, key1 long, key2 long, n long, digest binary, low binary, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    known = _Words()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(shingle_sets(batch.column(1).to_pylist(), known))], ["node", "shingles"])
    return map_batches(texts, run, "node long, shingles array<long>")


def _met(nodes: DataFrame) -> DataFrame:
    """key, node, n, lead and lead_n: the nodes that share a bucket with another, its lead."""
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    filled = staged(rows.join(rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "key"), "buckets")
    fullness = filled.groupBy("node").agg(F.sum("rows").alias("fullness"))
    best = F.max(F.struct("fullness", (-F.col("node")).alias("first"), "node", "n")).alias("lead")
    leads = filled.join(fullness, "node").groupBy("key").agg(best)
    return filled.join(leads, "key").where(F.col("node") != F.col("lead.node")).select(
        "key", "node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"))


def _sizes_allow() -> Column:
    """Whether sets of na and nb members can be 0.8 alike."""
    return 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
        return batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= LEAST_SHARED))
    sided = (pairs.select("a", "b").join(nodes.select(F.col("node").alias("a"), F.col("low").alias("x")), "a")
             .join(nodes.select(F.col("node").alias("b"), F.col("low").alias("y")), "b"))
    return map_batches(sided.select("a", "b", "x", "y"), run, "a long, b long", 8192)


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are 0.8 alike."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = _likely(pairs, nodes).join(left, "a").join(right, "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return shared.where("9 * shared >= 4 * total").select("a", "b")


def _rare_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes (node, root) in different components that share one of their rarest shingles; no linked pair is missing."""
    tokens = sets.join(left, "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    ordered = tokens.join(counts, "token").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("tokens"))
    # Shingles of one node only take the first places and meet nobody.
    placed = ordered.select("node", "root", "n", (F.col("n") - F.size("tokens")).alias("own"), F.posexplode("tokens").alias("pos", "t"))
    first = staged(placed.select("node", "root", "n", F.col("t.token").alias("token"), (F.col("own") + F.col("pos") + 1).alias("place"))
                   .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1), "rarest")
    # The largest component of a shingle needn't meet itself.
    shared = first.groupBy("token", "root").agg(F.count("*").alias("members")).groupBy("token").agg(
        F.max(F.struct("members", "root"))["root"].alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    rows = staged(first.join(shared, "token"), "rare")
    some = rows.where("root != largest").select("token", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("place").alias("pa"))
    every = rows.select("token", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("place").alias("pb"), "largest")
    common = F.ceil((F.col("na") + F.col("nb")) * 4 / 9)
    met = some.join(every, "token").where("ra != rb AND (a < b OR rb = largest)").where(
        _sizes_allow() & (F.col("pa") + common <= F.col("na") + 1) & (F.col("pb") + common <= F.col("nb") + 1))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _left_over(met: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes (node, root) of buckets that hold more than one component beside their lead's links."""
    rows = met.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    return rows.join(mixed, "key").select("node", "root").distinct()


def _grouped(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per document: id, key1, key2, n and root (null for an empty set)."""
    text = F.coalesce(docs[text_column], F.lit(""))
    texts = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(_SEED), text).alias("key2"),
                        text.cast("binary").alias("text"))
    known = staged(_sketches(texts, docs.schema[id_column].dataType.simpleString()), "sketches")
    # Numbers are written before they are used, so a task that runs again can't change them.
    nodes = staged(known.where("n > 0").drop("id").dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "nodes")
    met = staged(_met(nodes), "met")
    first = met.select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("lead_n").alias("na"), F.col("n").alias("nb"))
    members = met.select("node").union(met.select("lead")).distinct()
    wanted = nodes.join(members, "node", "left_semi").select("node", "key1", "key2")
    single = texts.groupBy("key1", "key2").agg(F.first("text").alias("text"))
    sets = staged(_sets(single.join(wanted, ["key1", "key2"]).select("node", "text")), "sets")
    links = staged(_links(first.where(_sizes_allow()).distinct(), nodes, sets), "star_links")
    found = staged(components(links).select("root", F.col("fp").alias("node")), "star_components")
    left = staged(_left_over(met, found), "left_over")
    if not left.isEmpty():
        every = links.unionByName(_links(staged(_rare_pairs(left, sets), "rare_pairs"), nodes, sets))
        found = staged(components(every).select("root", F.col("fp").alias("node")), "all_components")
    rooted = staged(nodes.join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "rooted")
    return known.select("id", "key1", "key2", "n", "digest").join(rooted, "digest", "left").select("id", "key1", "key2", "n", "root")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept."""
    rows = staged(_grouped(docs, id_column, text_column), "grouped")
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    return rows.join(least, "root", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


by_value(__name__)

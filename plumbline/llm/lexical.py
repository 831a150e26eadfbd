"""Ranked lexical search: the best documents for each item, by an exact dual-tree search.

Terms are runs of ASCII letters, digits and characters beyond ASCII. An item is a vector of term weights, a
document a vector of what each term adds for its frequency and the document's length, and a score their
product, all in whole numbers below 2 ** 53, which doubles hold exactly.

Both sides have a hierarchy whose nodes hold the largest value of each coordinate below them. The product of
two nodes bounds every score between them, so a pair of nodes goes when its bound is below the weakest k-th
score of the node's items so far; what is left is scored exactly. Ties at the k-th score are never
pruned. A first search over one in ``SEED_EVERY`` documents gives each item a k-th score that the whole search can
only raise; it changes what is pruned, and no result.

Documents are read once: each keeps its length and the frequencies of terms that items ask for. Blocks of
them are searched where they lie, and a task returns ``k`` documents an item at most. Items are a query set:
they are taken in passes of about ``PASS_CHARACTERS``, whose tables are broadcast, so neither broadcasts nor the
driver grow with the number of items or documents.

Defined cases: null and empty texts have no terms and are never ranked; an item without terms has no rows. Rows with
equal item ids are items of their own. Repeated document ids are ranked one by one; equal scores come by ascending
id, null last. An empty table on either side gives no rows. Other columns are neither read nor renamed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import by_value, map_batches, staged

K = 10
PASS_CHARACTERS = 1 << 22
SEED_EVERY = 32
BATCH_ITEMS = 128
BATCH_TERMS = 1 << 14
ITEM_LEAF = 8
LEAF = 32
FAN = 8
BLOCK = LEAF * FAN * 4
_CELLS = 1 << 22
# Lower case, and a space for everything in ASCII that isn't a letter or digit.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


class Batch(NamedTuple):
    """Some items: their numbers, their terms in common, and the levels of their tree (maxima, leaves first)."""

    items: np.ndarray
    terms: np.ndarray
    vectors: np.ndarray
    leaves: np.ndarray
    nodes: np.ndarray


class Corpus(NamedTuple):
    documents: int
    terms: int


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What a term adds for each unit of its weight."""
    m = 10 + 90 * n * corpus.documents // corpus.terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _maxima(rows: np.ndarray, size: int) -> np.ndarray:
    return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)


def item_batches(item_terms: list[np.ndarray], weights: np.ndarray) -> list[Batch]:
    """The items with a term, in batches of bounded size; items with heavy terms in common stand together."""
    order = sorted((n for n, t in enumerate(item_terms) if len(t)), key=lambda n: sorted(item_terms[n], key=lambda t: (-weights[t], t))[:3])
    batches, at = [], 0
    while at < len(order):
        size, end = 0, at
        while end < len(order) and end - at < BATCH_ITEMS and (end == at or size + len(item_terms[order[end]]) <= BATCH_TERMS):
            size += len(item_terms[order[end]])
            end += 1
        items = np.array(order[at:end])
        terms = np.unique(np.concatenate([item_terms[n] for n in items]))
        vectors = np.zeros((len(items), len(terms)))
        for row, n in enumerate(items):
            vectors[row, np.searchsorted(terms, item_terms[n])] = weights[item_terms[n]]
        leaves = _maxima(vectors, ITEM_LEAF)
        batches.append(Batch(items, terms, vectors, leaves, _maxima(leaves, FAN)))
        at = end
    return batches


def _weakest(floors: np.ndarray, size: int) -> np.ndarray:
    return np.minimum.reduceat(floors, np.arange(0, len(floors), size))


def search_block(batch: Batch, owner: np.ndarray, term: np.ndarray, value: np.ndarray, documents: int,
                 floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Item rows, documents and scores of every pair that scores at least the item's floor and above 0, and how many
    pairs were scored. ``owner``, ``term`` and ``value`` are the documents' entries; documents that share their
    heaviest terms should stand together."""
    place = np.minimum(np.searchsorted(batch.terms, term), len(batch.terms) - 1)
    held = batch.terms[place] == term
    vectors = np.zeros((documents, len(batch.terms)))
    vectors[owner[held], place[held]] = value[held]
    leaves = _maxima(vectors, LEAF)
    nodes = _maxima(leaves, FAN)
    leaf_floors = _weakest(floors, ITEM_LEAF)
    node_floors = _weakest(leaf_floors, FAN)
    rows, found, scores, scored = [], [], [], 0
    upper = batch.nodes @ nodes.T
    open_nodes = (upper >= node_floors[:, None]) & (upper > 0)
    for item_node in np.flatnonzero(open_nodes.any(axis=1)):
        item_leaves = np.arange(item_node * FAN, min((item_node + 1) * FAN, len(batch.leaves)))
        below = (np.flatnonzero(open_nodes[item_node])[:, None] * FAN + np.arange(FAN)).ravel()
        below = below[below < len(leaves)]
        bounds = batch.leaves[item_leaves] @ leaves[below].T
        open_leaves = (bounds >= leaf_floors[item_leaves, None]) & (bounds > 0)
        for row, item_leaf in enumerate(item_leaves):
            chosen = below[open_leaves[row]]
            if not len(chosen):
                continue
            docs = (chosen[:, None] * LEAF + np.arange(LEAF)).ravel()
            docs = docs[docs < documents]
            columns = np.flatnonzero(batch.leaves[item_leaf])
            items = np.arange(item_leaf * ITEM_LEAF, min((item_leaf + 1) * ITEM_LEAF, len(batch.items)))
            exact = batch.vectors[np.ix_(items, columns)] @ vectors[np.ix_(docs, columns)].T
            scored += exact.size
            good = np.nonzero((exact >= floors[items, None]) & (exact > 0))
            rows.append(items[good[0]])
            found.append(docs[good[1]])
            scores.append(exact[good].astype(np.int64))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(rows), join(found), join(scores), scored


class Best:
    """The best ``k`` documents an item so far, and each item's floor: the score that a document needs to matter."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.floors, self.k, self.table = floors.copy(), k, None

    def add(self, items: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        fresh = pa.table({"item": items, "id": ids, "score": scores})
        every = fresh if self.table is None else pa.concat_tables([self.table, fresh])
        every = every.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])
        numbers = every["item"].to_numpy()
        first = np.searchsorted(numbers, numbers)
        rank = np.arange(len(numbers)) - first
        kth = np.flatnonzero(rank == self.k - 1)
        self.floors[numbers[kth]] = np.maximum(self.floors[numbers[kth]], every["score"].to_numpy()[kth])
        self.table = every.filter(pa.array(rank < self.k))


def _ordered(owner: np.ndarray, term: np.ndarray, value: np.ndarray, gain: np.ndarray, documents: int) -> np.ndarray:
    """The documents, those with the same heaviest term side by side."""
    order = np.lexsort((term, -gain, owner))
    heaviest = np.full(documents, -1)
    heads = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1]))) if len(order) else order
    heaviest[owner[order][heads]] = term[order][heads]
    return np.argsort(heaviest, kind="stable")


def _search_batch(batch: pa.RecordBatch, batches: list[Batch], weights: np.ndarray, corpus: Corpus, best: Best) -> None:
    """One Arrow batch (id, n, terms, tfs) against all items."""
    ids, n = batch.column(0), batch.column(1).to_numpy()
    lists = batch.column(2)
    offsets = lists.offsets.to_numpy()
    term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), np.diff(offsets))
    value = impacts(tf, n[owner], corpus) if len(tf) else tf
    order = _ordered(owner, term, value, value * weights[term], len(n))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    owner = rank[owner]
    by_owner = np.argsort(owner, kind="stable")
    owner, term, value = owner[by_owner], term[by_owner], value[by_owner]
    for items in batches:
        step = max(LEAF, min(BLOCK, _CELLS // len(items.terms) // LEAF * LEAF))
        for first in range(0, len(n), step):
            last = min(first + step, len(n))
            a, b = np.searchsorted(owner, [first, last])
            rows, docs, scores, _ = search_block(items, owner[a:b] - first, term[a:b], value[a:b], last - first, best.floors[items.items])
            if len(rows):
                best.add(items.items[rows], ids.take(pa.array(order[docs + first])), scores)


def _search(vectors: DataFrame, batches: list[Batch], weights: np.ndarray, corpus: Corpus, floors: np.ndarray, k: int) -> DataFrame:
    """item, id and score of the best documents of each task."""
    kind = vectors.schema["id"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(
        ([tuple(b) for b in batches], weights, tuple(corpus), floors))  # plain tuples, so that workers need not have the package

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, weights, corpus, floors = shared.value
        batches, best = [Batch(*b) for b in plain], Best(floors, k)
        for part in parts:
            if part.num_rows:
                _search_batch(part, batches, weights, Corpus(*corpus), best)
        if best.table is not None:
            yield from best.table.to_batches()
    return vectors.mapInArrow(run, f"item long, id {kind}, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """id, n (terms with repeats), terms and tfs (of the terms that items ask for) of each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, keep, n, ends, terms, tfs = shared.value, [], [], [0], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            words = terms_of(text)
            if words:
                at, times = np.unique(np.array([known[w] for w in words if w in known], np.int32), return_counts=True)
                keep.append(row)
                n.append(len(words))
                ends.append(ends[-1] + len(at))
                terms.append(at)
                tfs.append(times)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int32)]).astype(np.int32)))
                 for x in (terms, tfs)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("binary").alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, n long, terms array<int>, tfs array<int>")


def _ranked_pass(docs: DataFrame, texts: list[bytes | None], k: int, id_column: str, text_column: str) -> DataFrame:
    """item (position in ``texts``), id, score and rank."""
    vocabulary: dict[bytes, int] = {}
    item_terms = [np.unique(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in terms_of(t)], np.int64)) for t in texts]
    vectors = staged(_vectors(docs, vocabulary, id_column, text_column), "vectors")
    total = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    corpus = Corpus(total.documents, total.terms or 1)
    # One row for each term of the pass at most.
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    weights = np.zeros(max(len(vocabulary), 1))
    for term, df in zip(counted["term"].to_pylist(), counted["df"].to_pylist()):
        weights[term] = weight(df, corpus.documents)
    batches = item_batches(item_terms, weights)
    floors = np.zeros(len(texts))
    sample = vectors.where(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_EVERY)) == 0)
    seeds = _top(_search(sample, batches, weights, corpus, floors, k), k).where(F.col("rank") == k).select("item", "score").toArrow()
    floors[seeds["item"].to_numpy()] = seeds["score"].to_numpy()
    return _top(_search(vectors, batches, weights, corpus, floors, k), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_column: str = "doc_id", text_column: str = "text",
           item_id: str = "item_id", item_text: str = "text", pass_characters: int = PASS_CHARACTERS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0."""
    numbered = staged(items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))
                      .withColumn("number", F.monotonically_increasing_id()), "items")
    characters = numbered.agg(F.sum(F.char_length("text"))).first()[0] or 0
    passes = characters // pass_characters + 1
    found = None
    for own in range(passes):
        part = numbered.where(F.col("number") % passes == own).select("number", F.col("text").cast("binary").alias("text")).toArrow()
        numbers = part["number"].to_pylist()
        best = _ranked_pass(docs, part["text"].to_pylist(), k, id_column, text_column)
        place = docs.sparkSession.createDataFrame(list(enumerate(numbers)), "item long, number long")
        best = staged(best.join(place, "item").select("number", "rank", "id", "score"), "ranked")
        found = best if found is None else found.unionByName(best)
    return found.join(numbered.select("number", "item_id"), "number").select(
        F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_column), "score")


by_value(__name__)

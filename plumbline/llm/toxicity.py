"""Toxicity: a convolutional text classifier, trained in numpy.

Words are hashed to rows of an embedding table; filters of several widths slide over the whole text and
the strongest response of each filter (max pooling) goes to a logistic output. Training takes every labelled
row and scoring every row, both with whole texts. Only words are inputs: no id, source, language or label.

The first embedding dimension starts at each word's deviation from an equal share of both classes, counted over all training rows,
the rest at small random numbers. Rows are dealt by the hash of their id into parts of some ``PART`` characters; a task trains each part
from that common start, and the model is the mean of theirs, weighted by rows. Seeds, parts and the order in a part are fixed, so reruns agree.
A part of the rows (``HELD``) isn't trained on: all of it sets the scale of the scores (0.7 is the score that parts the classes best there)
and a threshold for each language, from counts of logits to 1/``STEPS``.

The trained tables have a fixed size (``BUCKETS`` x filters), whatever the input, and are sent to the tasks.

Defined cases: null or empty text: the score of a text of padding only. Labels that are null, repeated (the
larger counts) or without a document are fine; null texts aren't trained on. Without both classes in both parts every score is 0. A
language without both classes in the held part has the common threshold. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_value, column_or_null, drop_staged, map_batches, packed, release

BUCKETS = 1 << 17
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
# A word is hashed whole and by its first bytes, so that forms of one stem share an embedding.
PREFIXES = (None, 4, 6)
# Characters of text that one model is trained on.
PART = 16_000_000
# The tables are summed in pieces, at most so many parts at once.
PIECES = 64
BUNDLE = 64
STEPS = 1024
HIGHEST = 32
HELD = 0.25
EPOCHS = 5
BATCH = 32
RATE = 0.003
DECAY = 0.01
LEAST_DEVIATION = 3.0
CLEAN_COST = 5
THRESHOLD = 0.7
_PADDING = max(WIDTHS) - 1
_CHUNK = 1 << 18
# Lower case, and a space for everything in ASCII that isn't a letter or digit.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words; empty ones at the end are padding for the widest filter."""
    words = text.translate(_PLAIN).split()
    return words + [b""] * (_PADDING + (not words))


def buckets(words: list[bytes]) -> np.ndarray:
    """The buckets of each word; bucket 0 is padding."""
    found = np.zeros((len(words), len(PREFIXES)), np.int64)
    for k, size in enumerate(PREFIXES):
        found[:, k] = np.fromiter((crc32(w[:size], k + 1) if w else 0 for w in words), np.int64, len(words))
    return np.where(found > 0, found % (BUCKETS - 1) + 1, 0)


@dataclass
class Model:
    """Embeddings, filters and the output layer, and the scale of the scores."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    constant: float
    scale: tuple[float, float] = (1.0, 0.0)

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        pooled = np.empty((len(texts), len(WIDTHS) * FILTERS), np.float32)
        for first, last in _chunks(texts):
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(w, len(known)) for t in texts[first:last] for w in t], np.int64)
            length = np.fromiter(map(len, texts[first:last]), np.int64, last - first)
            pooled[first:last] = self._pooled(self.table[buckets(list(known))].sum(axis=1), ids, np.cumsum(length) - length, length)
        return np.maximum(pooled + self.bias, 0) @ self.output + self.constant

    def _pooled(self, vectors: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        # A text's last windows would reach into the next one; its padding makes room for them.
        edges = np.stack((start, start + length - _PADDING), axis=1).ravel()
        found = []
        for f in self.filters:
            size = len(ids) - len(f) + 1
            total = (vectors @ f[0])[ids[:size]]
            for offset in range(1, len(f)):
                total += (vectors @ f[offset])[ids[offset:offset + size]]
            found.append(np.maximum.reduceat(total, edges[:-1] if edges[-1] >= size else edges, axis=0)[::2])
        return np.concatenate(found, axis=1)

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        return self.scaled(self.logits(texts).astype(np.float64))

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        slope, cut = self.scale
        return 1 / (1 + np.exp(-np.clip(slope * (logits - cut), -30, 30) - np.log(THRESHOLD / (1 - THRESHOLD))))


def _chunks(texts: list[np.ndarray]):
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= _CHUNK:
            yield first, at + 1
            first, size = at + 1, 0
    if first < len(texts):
        yield first, len(texts)


def counted(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The number of texts of each class with a bucket."""
    seen = np.zeros((2, BUCKETS), np.float32)
    for text, label in zip(texts, labels):
        seen[label, np.unique(text)] += 1
    return seen


def trained(texts: list[np.ndarray], labels: np.ndarray, seed: int = 0, seen: np.ndarray | None = None, rate: float | None = None) -> Model:
    """A model for texts of word buckets and labels 0 or 1, both of which must occur, here or in ``seen`` and ``rate`` of all parts."""
    random = np.random.default_rng(seed)
    kinds = len(WIDTHS) * FILTERS
    table = random.normal(0, 0.03, (BUCKETS, DIMENSIONS)).astype(np.float32)
    seen = counted(texts, labels) if seen is None else seen
    rate = labels.mean() if rate is None else rate
    expected = seen.sum(axis=0) * rate
    deviation = (seen[1] - expected) / np.sqrt(expected * (1 - rate) + 1)
    table[:, 0] = np.where(np.abs(deviation) < LEAST_DEVIATION, 0, 2 * deviation / max(float(np.abs(deviation).max()), 1))
    table[0] = 0
    filters = [random.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.2
    weight = np.where(labels == 1, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
    bias, output, constant = np.zeros(kinds, np.float32), np.full(kinds, 0.1, np.float32), np.zeros(1, np.float32)
    parts = [table, *filters, bias, output, constant]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            step += 1
            touched, gradients = _gradients([texts[i] for i in rows], labels[rows], weight[rows], table, filters, bias, output, constant)
            for part, gradient, mean, square, own in zip(parts, gradients, means, squares, [touched] + [slice(None)] * len(parts)):
                mean[own] += 0.1 * (gradient - mean[own])
                square[own] += 0.001 * (gradient * gradient - square[own])
                step_size = mean[own] / (1 - 0.9 ** step) / (np.sqrt(square[own] / (1 - 0.999 ** step)) + 1e-8)
                part[own] -= RATE * (step_size + DECAY * part[own])
            table[0] = 0
    return Model(table, filters, bias, output, float(constant[0]))


def _gradients(texts, labels, weight, table, filters, bias, output, constant):
    """The rows of the table that the pooled windows touch, and the gradient of every part."""
    ids = np.concatenate(texts)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(length) - length
    best, pooled = [np.empty((len(texts), FILTERS), np.int64) for _ in filters], [np.full((len(texts), FILTERS), -np.inf, table.dtype) for _ in filters]
    for row, (s, n) in enumerate(zip(start, length)):
        # Long texts in pieces that overlap by a window; the first of equal responses counts.
        for first in range(s, s + n - _PADDING, _CHUNK):
            size = min(_CHUNK, s + n - _PADDING - first)
            vectors = table[ids[first:first + size + _PADDING]].sum(axis=1)
            for f, at, top in zip(filters, best, pooled):
                total = sum(vectors[j:j + size] @ f[j] for j in range(len(f)))
                place = np.argmax(total, axis=0)
                value = np.take_along_axis(total, place[None], axis=0)[0]
                at[row], top[row] = np.where(value > top[row], first + place, at[row]), np.maximum(value, top[row])
    hidden = np.concatenate(pooled, axis=1) + bias
    active = np.maximum(hidden, 0)
    error = (1 / (1 + np.exp(-np.clip(active @ output + constant, -30, 30))) - labels).astype(np.float32)[:, None] * weight[:, None] / len(texts)
    back = error * output * (hidden > 0)
    rows, values, grad_filters = [], [], []
    for k, (f, at) in enumerate(zip(filters, best)):
        part = back[:, k * FILTERS:(k + 1) * FILTERS]
        grad = np.empty_like(f)
        for j in range(len(f)):
            grad[j] = np.einsum("nf,nfd->df", part, table[ids[at + j]].sum(axis=2))
            rows.append(ids[at + j].reshape(-1, len(PREFIXES)))
            values.append((part[:, :, None] * f[j].T).reshape(-1, DIMENSIONS))
        grad_filters.append(grad)
    touched, place = np.unique(np.concatenate(rows), return_inverse=True)
    grad_table, values = np.zeros((len(touched), DIMENSIONS), np.float32), np.concatenate(values)
    for k in range(len(PREFIXES)):
        np.add.at(grad_table, place.reshape(-1, len(PREFIXES))[:, k], values)
    return touched, [grad_table, *grad_filters, back.sum(axis=0), (error * active).sum(axis=0), error.sum(axis=0)]


def _best_cut(logits: np.ndarray, counts: np.ndarray) -> float:
    """The middle of the gap that parts the classes best, for ascending logits and the rows of both classes at each:
    a share of class 0 above it costs ``CLEAN_COST`` times as much as the same share of class 1 below it."""
    right, below = (np.concatenate(([0], np.cumsum(c))) / c.sum() for c in counts)
    gain = CLEAN_COST * right - below
    best = np.flatnonzero(np.isclose(gain, gain.max()))
    at = int(best[len(best) // 2])
    return float((logits[max(at - 1, 0)] + logits[min(at, len(logits) - 1)]) / 2)


def _median(logits: np.ndarray, counts: np.ndarray) -> float:
    ends = np.cumsum(counts)
    return float((logits[np.searchsorted(ends, (ends[-1] - 1) // 2, "right")] + logits[np.searchsorted(ends, ends[-1] // 2, "right")]) / 2)


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, language_column: str, label_id: str, label: str) -> DataFrame:
    """(id, language, text, toxic, held): one row for each labelled id with a text."""
    known = (labels.where(labels[label].isin(0, 1)).groupBy(labels[label_id].alias("id")).agg(F.max(label).cast("int").alias("toxic"))
             .where("id IS NOT NULL").where(~held_out(F.col("id"))))
    texts = docs.where(docs[text_column].isNotNull()).where(~held_out(docs[id_column])).select(
        docs[id_column].alias("id"), F.coalesce(column_or_null(docs, language_column, "string"), F.lit("")).alias("language"),
        docs[text_column].cast("binary").alias("text"))
    rows = texts.groupBy("id").agg(F.min(F.struct("language", "text")).alias("x")).join(known, "id")
    return rows.select("id", "x.language", "x.text", "toxic", (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(round(1 / HELD))) == 0).alias("held"))


def _sample(*arguments) -> tuple[list, np.ndarray, np.ndarray]:
    """The words, labels and languages of all labelled rows, for a look at a small table."""
    found = _labelled(*arguments).orderBy("id").toArrow()
    return [words_of(x) for x in found["text"].to_pylist()], found["toxic"].to_numpy(), np.array(found["language"].to_pylist(), object)


def _pieces(part: int, values: np.ndarray) -> pa.RecordBatch:
    pieces = np.array_split(values.astype(np.float32).ravel(), PIECES)
    return pa.RecordBatch.from_arrays([pa.array([part] * PIECES, pa.int64()), pa.array(range(PIECES), pa.int64()),
                                       pa.array([x.tobytes() for x in pieces], pa.binary())], ["part", "piece", "x"])


_PIECES_SCHEMA = "part long, piece long, x binary"


def _summed(rows: DataFrame) -> np.ndarray:
    """The sum of the arrays of all parts, whose size is fixed; a task adds up one piece of ``BUNDLE`` parts."""
    def add(kind: type):
        def run(key, table):
            table = table.sort_by("part")
            total = sum(np.frombuffer(x.as_py(), kind).astype(np.float64) for x in table["x"])
            return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "piece": pa.array([key[1].as_py()], pa.int64()), "x": pa.array([total.tobytes()], pa.binary())})
        return run
    bundles = rows.groupBy(F.floor(F.col("part") / BUNDLE).alias("bundle"), "piece").applyInArrow(add(np.float32), _PIECES_SCHEMA)
    found = bundles.groupBy(F.lit(0).alias("all"), "piece").applyInArrow(add(np.float64), _PIECES_SCHEMA).toArrow().sort_by("piece")
    return np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in found["x"]])


def _seen(rows: DataFrame) -> np.ndarray:
    def run(batches):
        seen = np.zeros((2, BUCKETS), np.float32)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                seen[label.as_py(), np.unique(buckets(words_of(text.as_py())))] += 1
        yield _pieces(TaskContext.get().partitionId(), seen)
    return _summed(rows.select("text", "toxic").mapInArrow(run, _PIECES_SCHEMA)).reshape(2, BUCKETS)


def _averaged(rows: DataFrame, parts: int, count: int, seen: np.ndarray, rate: float) -> Model:
    """The mean of the models that are trained on the parts, each with its share of the rows as weight."""
    shared = rows.sparkSession.sparkContext.broadcast(seen.astype(np.float32))

    def run(key, table):
        table = table.sort_by("id")
        texts = [buckets(words_of(x.as_py())).astype(np.int32) for x in table["text"]]
        m = trained(texts, table["toxic"].to_numpy().astype(np.int64), seen=shared.value, rate=rate)
        flat = np.concatenate([x.ravel() for x in (m.table, *m.filters, m.bias, m.output, np.array([m.constant]))])
        return pa.Table.from_batches([_pieces(key[0].as_py(), flat * (len(texts) / count))])
    dealt = rows.select("id", "text", "toxic", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).alias("part"))
    flat = _summed(dealt.groupBy("part").applyInArrow(run, _PIECES_SCHEMA)).astype(np.float32)
    kinds = len(WIDTHS) * FILTERS
    shapes = [(BUCKETS, DIMENSIONS), *[(w, DIMENSIONS, FILTERS) for w in WIDTHS], (kinds,), (kinds,), (1,)]
    ends = np.cumsum([int(np.prod(x)) for x in shapes])
    found = [x.reshape(shape) for x, shape in zip(np.split(flat, ends[:-1]), shapes)]
    return Model(found[0], found[1:-3], found[-3], found[-2], float(found[-1][0]))


def fitted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang",
           label_id: str = "doc_id", label: str = "toxic") -> tuple[Model | None, dict[str, float]]:
    """The model and the threshold of each language."""
    rows, path = packed(_labelled(docs, labels, id_column, text_column, language_column, label_id, label), "labelled")
    release(docs.sparkSession)
    sizes = {(r.held, r.toxic): r for r in rows.groupBy("held", "toxic").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}
    if len(sizes) < 4:
        return None, {}
    count = sizes[False, 0].n + sizes[False, 1].n
    parts = -(-(sizes[False, 0].size + sizes[False, 1].size + 1) // PART)
    learnt = rows.where("NOT held")
    model = _averaged(learnt, parts, count, _seen(learnt), sizes[False, 1].n / count)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        logits = Model(**shared.value).logits([words_of(x) for x in batch.column(2).to_pylist()]).astype(np.float64)
        places = np.rint(np.clip(logits, -HIGHEST, HIGHEST) * STEPS).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places)], ["language", "toxic", "place"])
    # At most 2 * HIGHEST * STEPS places for each language and class.
    found = (map_batches(rows.where("held").select("language", "toxic", "text"), run, "language string, toxic int, place long")
             .groupBy("language", "toxic", "place").count().toArrow())
    drop_staged(docs.sparkSession, path)
    language, toxic, place, n = (np.array(found[c].to_pylist(), object if c == "language" else np.int64) for c in ("language", "toxic", "place", "count"))

    def table(here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, at = np.unique(place[here], return_inverse=True)
        counts = np.zeros((2, len(places)), np.int64)
        np.add.at(counts, (toxic[here], at), n[here])
        return places / STEPS, counts
    logits, counts = table(np.ones(len(n), bool))
    model.scale = (6.0 / max(_median(logits, counts[1]) - _median(logits, counts[0]), 1e-3), _best_cut(logits, counts))
    thresholds = {}
    for name in sorted(set(language)):
        logits, counts = table(language == name)
        if counts.any(axis=1).all():
            thresholds[name] = float(model.scaled(np.array([_best_cut(logits, counts)]))[0])
    return model, thresholds


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang",
           label_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted, language_threshold and flagged (by that threshold)."""
    model, thresholds = fitted(docs, labels, id_column, text_column, language_column, label_id, label)
    # Plain values only: a broadcast object of a class of this package would need the package on every worker.
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        scores = np.zeros(len(texts))
        if shared.value is not None:
            model = Model(**shared.value)
            for at in range(0, len(texts), 256):
                scores[at:at + 256] = model.scores([words_of(x) for x in texts[at:at + 256]])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], [id_column, "_language", "score"])
    rows = docs.select(docs[id_column], F.coalesce(column_or_null(docs, language_column, "string"), F.lit("")).alias("_language"),
                       F.coalesce(docs[text_column], F.lit("")).cast("binary").alias("_text"))
    found = map_batches(rows, run, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, _language string, score double")
    limits = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair]) if thresholds else F.create_map().cast("map<string,double>")
    limit = F.coalesce(F.try_element_at(limits, F.col("_language")), F.lit(THRESHOLD))
    return found.select(id_column, F.coalesce(held_out(F.col(id_column)), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), limit.alias("language_threshold"),
                        (F.col("score") >= limit).alias("flagged"))


by_value(__name__)

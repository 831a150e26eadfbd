"""URL filter: explicit rules, and a character language-model ratio for what they leave open.

Urls that a rule accepts or rejects train two Markov models over bytes. The order is variable: the
probability after a context of n bytes is smoothed with that after n - 1 bytes, so an unseen context
hands over to shorter ones. A url's score is the mean, over its bytes, of the log-likelihood
difference (rejected minus accepted). One url in ``FOLDS`` (by checksum) doesn't train but calibrates:
the cutoff is where accepted and rejected ones are parted best.

Counts are exact: a context or gram is its own key (up to six bytes in a long), and the model is a Spark table
of key and counts that grows with the rule-decided urls. Urls are scored in pieces: each asks the model once for
each of its distinct keys, and a task holds only the counts of one piece.

Defined cases: null, or without ``://``: empty host and path, no rule, and the method judges the (empty)
text. Without training urls of both kinds the method allows. Of rules of one length, block wins.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_value, column_or_null, map_batches, staged

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 5
STRENGTH = 2.0
FOLDS = 5
_BINS, _WIDTH = 4000, 0.005


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none fits."""
    fits = []
    for verdict, rule in rules:
        domain, _, start = rule.partition("/")
        own = (host_ == domain) | F.endswith(host_, F.lit("." + domain))
        fits.append(F.when(own & F.startswith(path_, F.lit("/" + start)), F.struct(
            F.lit(len(rule)).alias("length"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,verdict:string,rule:string>")


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte and order the exact keys of its context and of context and byte, and each byte's text."""
    pad = bytes([2] * ORDER)
    data = np.frombuffer(b"".join(pad + t + b"\x03" for t in texts), np.uint8).astype(np.int64)
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = np.arange(length.sum()) + np.repeat(np.arange(1, len(texts) + 1) * ORDER, length)
    contexts, grams = np.empty((ORDER + 1, len(at)), np.int64), np.empty((ORDER + 1, len(at)), np.int64)
    state = np.zeros(len(at), np.int64)
    for order in range(ORDER + 1):
        if order:
            state = state | data[at - order] << 8 * (order - 1)
        contexts[order] = order << 8 * (ORDER + 1) | state
        grams[order] = _GRAM | order << 8 * (ORDER + 1) | state << 8 | data[at]
    return contexts, grams, np.repeat(np.arange(len(texts)), length)


_GRAM = 1 << 8 * (ORDER + 1) + 3  # keys: bytes, then three bits of order, then context or gram
_PIECE = 1000


def _model(urls: DataFrame) -> DataFrame:
    """key, and how often accepted (n0) and rejected (n1) urls have it."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = np.array(batch.column(1).to_pylist(), np.int64)
        contexts, grams, owner = _keys(batch.column(0).to_pylist())
        found = []
        for k in (0, 1):
            own = kind[owner] == k
            key, n = np.unique(np.concatenate((contexts[:, own].ravel(), grams[:, own].ravel())), return_counts=True)
            found.append((key, n if k == 0 else 0 * n, n if k == 1 else 0 * n))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["key", "n0", "n1"])
    counted = map_batches(urls, run, "key long, n0 long, n1 long", _PIECE)
    return counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _scores(texts: list[bytes], key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The scores of texts; ``key`` is sorted and holds every key of theirs that the model has."""
    contexts, grams, owner = _keys(texts)
    key, counts = np.append(key, -1), np.concatenate((counts, np.zeros((2, 1))), axis=1)  # the last one: not seen

    def places(keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(key[:-1], keys)
        return np.where(key[at] == keys, at, len(key) - 1)
    context_at, gram_at = places(contexts), places(grams)
    log = []
    for kind in (0, 1):
        p = np.full(len(owner), 1 / 256)
        for order in range(ORDER + 1):
            p = (counts[kind, gram_at[order]] + STRENGTH * p) / (counts[kind, context_at[order]] + STRENGTH)
        log.append(np.log(p))
    return np.bincount(owner, log[1] - log[0], len(texts)) / np.bincount(owner, minlength=len(texts))


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """Adds the length-normalised log-likelihood difference of column ``_url`` to a staged table with ``_piece``.
    Each piece of some ``_PIECE`` urls asks once for each of its keys, so no key is hot in the join."""
    def asked(batch: pa.RecordBatch) -> pa.RecordBatch:
        piece, texts = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
        pieces, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in np.unique(piece):
            contexts, grams, _ = _keys([texts[i] for i in np.flatnonzero(piece == p)])
            keys.append(np.unique(np.concatenate((contexts.ravel(), grams.ravel()))))
            pieces.append(np.full(len(keys[-1]), p))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(pieces)), pa.array(np.concatenate(keys))], ["_piece", "key"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, at = np.unique(right["key"].to_numpy(), return_index=True)
        counts = np.array([right["n0"].to_numpy()[at], right["n1"].to_numpy()[at]], np.float64)
        return left.append_column("_score", pa.array(_scores(left["_url"].to_pylist(), key, counts), pa.float64()))
    needed = map_batches(urls.select("_piece", "_url"), asked, "_piece long, key long", _PIECE).join(model, "key")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.groupBy("_piece").cogroup(needed.select("_piece", "key", "n0", "n1").groupBy("_piece")).applyInArrow(run, f"{kinds}, _score double")


def _cutoff(scores: DataFrame) -> float:
    """Where the rates of rejected urls above and accepted urls above differ most."""
    bins = F.least(F.greatest(F.floor(F.col("_score") / _WIDTH).cast("int") + _BINS // 2, F.lit(0)), F.lit(_BINS - 1))
    counted = scores.groupBy(bins.alias("bin"), "_kind").count().toPandas()
    table = np.zeros((2, _BINS))
    table[counted["_kind"].to_numpy(int), counted["bin"].to_numpy(int)] = counted["count"]
    if not table.sum(axis=1).all():
        return 0.0
    above = table[:, ::-1].cumsum(axis=1)[:, ::-1] / table.sum(axis=1, keepdims=True)
    best = np.flatnonzero(np.isclose(above[1] - above[0], (above[1] - above[0]).max()))
    return (float(best[0] + best[-1]) / 2 - _BINS // 2) * _WIDTH  # the middle of the gap


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict and the score of the method."""
    parts = pages.select(column_or_null(pages, id_column, "long").alias(id_column), host(pages[url_column]).alias("host"),
                         path(pages[url_column]).alias("path"), F.coalesce(pages[url_column], F.lit("")).cast("binary").alias("_url"))
    ruled = parts.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select(id_column, "host", "path", "_url", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("_verdict"))
    ruled = staged(ruled.withColumn("_piece", F.floor(F.monotonically_increasing_id() / _PIECE)), "ruled")
    kind, fold = F.when(F.col("_verdict") == "block", 1).otherwise(0).alias("_kind"), F.pmod(F.crc32("_url"), F.lit(FOLDS)) == 0
    model = staged(_model(ruled.where(F.col("_verdict").isNotNull() & ~fold).select("_url", kind)), "model")
    every = staged(scored(ruled, model), "scored")
    trained = model.where(F.col("key") == 0).first()  # the context of no bytes
    cut = _cutoff(every.where(F.col("_verdict").isNotNull() & fold).select("_score", kind)) if trained and trained["n0"] and trained["n1"] else float("inf")
    return every.select(
        id_column, "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_score") >= cut, "block").otherwise("allow")).alias("verdict"),
        F.col("_score").alias("score"))


by_value(__name__)

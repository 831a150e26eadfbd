"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from plumbline.llm import bpe, chat, lexical, licenses, minhash, mixing, naming, quality, simhash, spelling, suffix, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_word_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    found = chat.read_back(chat.formatted(chat.linear_messages(turns.unionByName(added))))
    number = F.when(F.col("tree") != "", F.substring("tree", 2, 20).cast("long"))
    return found.select(number.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_certified_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(_table(spark, sf_dir, "documents"))
    return mixed.select(mixed["id"].alias("doc_id"), "size", "source_size", "target", "taken")


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(_table(spark, sf_dir, "documents"))


def op6_diagonal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op7_markov_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op8_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op11_minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_word_convolution": op1_word_convolution,
    "op2_reply_trees": op2_reply_trees,
    "op3_certified_cutoffs": op3_certified_cutoffs,
    "op4_budget_cut": op4_budget_cut,
    "op5_block_naming": op5_block_naming,
    "op6_diagonal_votes": op6_diagonal_votes,
    "op7_markov_urls": op7_markov_urls,
    "op8_merge_rounds": op8_merge_rounds,
    "op9_run_length_index": op9_run_length_index,
    "op10_simhash_balls": op10_simhash_balls,
    "op11_minhash_bands": op11_minhash_bands,
    "op12_dual_tree": op12_dual_tree,
    "op13_fm_index": op13_fm_index,
}

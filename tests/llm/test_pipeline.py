"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from plumbline.llm import quality
from tests.compare import difference, duck
from tests.llm.cases import table
from tests.llm.test_dedup import brute_fingerprint, normal

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        found.append((name, docs.collect()))
    return dict(found)


def test_stage_names_and_columns(stages):
    assert list(stages) == ["documents", "quality_rules", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    assert stages["mix_sources"][0].__fields__ == stages["documents"][0].__fields__
    assert stages["encode"][0].__fields__ == [*stages["documents"][0].__fields__, "tokens", "decoded_sha256"]


def test_quality_keeps_what_it_judges_good(spark, stages):
    judged = quality.judged(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert {r.doc_id for r in stages["quality_rules"]} == kept and 0 < len(kept) < len(stages["documents"])


def test_dedup_keeps_the_first_of_each_group(stages):
    first = {}
    for r in sorted(stages["quality_rules"]):
        first.setdefault(normal(r.text), r.doc_id)
    assert sorted(r.doc_id for r in stages["exact_dedup"]) == sorted(first.values())
    prints = {r.doc_id: brute_fingerprint(r.text) for r in stages["exact_dedup"]}
    root = {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in sorted(prints):
        for b in sorted(prints):
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in stages["near_dedup"]) == sorted({find(i) for i in prints})


def test_mix_meets_its_targets(stages):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, mixed, texts = defaultdict(int), defaultdict(int), {r.doc_id: r.text for r in stages["near_dedup"]}
    for r in stages["near_dedup"]:
        sizes[r.source] += count(r.text)
    for r in stages["mix_sources"]:
        mixed[r.source] += count(r.text)
        assert r.text == texts[r.doc_id] or " ".join(texts[r.doc_id].split()).startswith(r.text)
    weights, names = {}, sorted(sizes)
    for n, name in enumerate(names):
        weights[name] = (3, 1, 2)[n % 3]
    left, goal = 1.5 * sum(sizes.values()), {}
    while True:  # reshare the excess until no source is above twice its size
        open_ = [s for s in names if s not in goal]
        share = (left - sum(goal.values())) / max(1, sum(weights[s] for s in open_))
        above = [s for s in open_ if share * weights[s] > 2 * sizes[s]]
        if not above:
            goal |= {s: share * weights[s] for s in open_}
            break
        goal |= {s: 2 * sizes[s] for s in above}
    assert all(abs(goal[s] - mixed[s]) < 1.001 for s in names)


def test_tokens_are_those_of_the_library(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    assert Counter(r.text for r in stages["encode"]) == Counter(r.text for r in stages["mix_sources"])
    assert all(list(r.tokens) == tokenizer.encode(r.text, add_special_tokens=False).ids for r in stages["encode"])
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in stages["encode"])


def test_every_stage_takes_awkward_rows_and_clashing_columns(spark):
    """Names that the operators use inside must neither break a stage nor be overwritten."""
    names = ["_id", "_key", "_hash", "_size", "_rows", "_pass", "_words", "_digest", "_sha", "_text", "_doc", "_row", "row", "number", "kept",
             "size", "taken", "own_id", "own_sha", "sha", "rows", "last", "w", "l", "m", "stratum", "text_sha256", "component_id"]
    plain = table(spark)
    docs = plain.drop(*names).select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n)
                                           for n in names], F.lit(7).alias("tokens"), F.lit("old").alias("decoded_sha256"))
    for name, stage in corpus_pipeline.STAGES:
        for source in (docs, docs.limit(0)):
            found = stage(spark, source, SF)
            added = ["tokens", "decoded_sha256"] if name == "encode" else []
            assert found.columns == [c for c in docs.columns if c not in added] + added
            rows = found.collect()
            assert bool(rows) == (source is docs and name != "quality_rules") or name == "quality_rules"
            assert all(r[n] == f"{n} of {'null' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
            assert not added or all(isinstance(r.tokens, list) and len(r.decoded_sha256) == 64 for r in rows)


def test_workers_need_not_have_the_package(tmp_path):
    """Started elsewhere, with the package loaded from its path in the driver alone, the Python tasks must still run."""
    script = tmp_path / "elsewhere.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from tests.session import local_session
from plumbline.llm import bpe, lexical, minhash, simhash, spelling, toxicity
import public_tokenizers
spark = local_session()
docs = spark.createDataFrame([(n, f"some words {{n % 7}} spelling spelling spelling in a text", "en") for n in range(60)], "doc_id long, text string, lang string")
labels = docs.selectExpr("doc_id", "cast(doc_id % 7 = 0 as int) as toxic")
path = public_tokenizers.path("byte_bpe_50k.json")
sys.path.remove({str(ROOT)!r})
for found in (toxicity.scored(docs, labels), bpe.digests(docs, path), bpe.decoded(bpe.with_tokens(docs, path, decoded_column="d"), path),
              minhash.near_groups(docs), simhash.near_groups(docs), lexical.ranked(docs, docs.selectExpr("doc_id as item_id", "text").limit(3)),
              spelling.variants(docs)):
    assert found.count() > 0
print("all ran")
""")
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(Path(public_tokenizers.__file__).parent)}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if re.match(r"op\d+_", n)))
def test_query_equals_sql(spark, name):
    assert difference(queries()[name](spark, SF), duck(SF), oracle_sql()[name]) is None

"""MinHash groups, ranked search and spelling variants against plain versions over all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from plumbline.llm import lexical, minhash, spelling
from tests.llm.cases import CASES, empty, table

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# MinHash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_groups(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(docs):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    return Counter((i, len(s), least.get(root(n)) if s else i) for n, ((i, _), s) in enumerate(zip(docs, sets)))


def changed(words, n):
    out = list(words)
    for at in random.sample(range(len(out)), n):
        out[at] = f"new{random.randint(0, 10 ** 6)}"
    return " ".join(out)


def groups(spark, docs):
    rows = minhash.near_groups(table(spark, docs)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_near_groups_against_all_pairs(spark):
    random.seed(21)
    docs, at = list(CASES), 1000
    for size in (9, 40, 150, 600):
        for _ in range(20):
            base = [f"b{random.randint(0, 10 ** 6)}" for _ in range(size)]
            for share in (0, 0.01, 0.02, 0.026, 0.03, 0.08):
                docs.append((at, changed(base, int(size * share))))
                at += 1
    assert groups(spark, docs) == brute_groups(docs)


def test_near_copies_inside_a_common_frame_are_all_found(spark):
    """Pages that share a frame meet in one bucket without being near copies; the pairs hidden among them must not be lost."""
    random.seed(22)
    frame, docs = [f"frame{n}" for n in range(440)], []
    for n in range(150):
        docs.append((n, " ".join(frame + [f"p{n}w{k}" for k in range(75)])))
    for n in range(30):
        own = [f"q{n}w{k}" for k in range(75)]
        docs += [(1000 + 2 * n, " ".join(frame + own)), (1001 + 2 * n, " ".join(frame + own[:60] + [f"r{n}w{k}" for k in range(15)]))]
    expected = brute_groups(docs)
    assert sum(i != c for i, _, c in expected) == 30
    assert groups(spark, docs) == expected


def test_a_large_group_is_one_component(spark):
    random.seed(23)
    base = [f"b{n}" for n in range(300)]
    docs = [(i, changed(base, 3)) for i in range(400)] + [(1000 + i, " ".join(base[:150]) + f" {i} " + changed(base[150:], 100)) for i in range(50)]
    assert groups(spark, docs) == brute_groups(docs)


def test_no_documents(spark):
    assert minhash.near_groups(empty(spark)).count() == 0


def test_sets_and_signatures_of_long_texts():
    random.seed(24)
    texts = [" ".join(f"w{random.randint(0, 10 ** 7)}" for _ in range(n)) for n in (90_000, 5, 40_000, 0, 3)]
    sets = minhash.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    alone = np.concatenate([minhash.signatures([s]) for s in sets])
    assert (minhash.signatures(sets) == alone).all()


# Ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute_ranks(docs, items, k):
    words = [(i, Counter(terms(t))) for i, t in docs]
    documents, total = sum(bool(c) for _, c in words), sum(c.total() for _, c in words)
    df = Counter(w for _, c in words for w in c)
    found = Counter()
    for item, text in items:
        scores = []
        for i, c in words:
            n = c.total()
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1)))
                        * (10 ** 9 * c[w] // (1000 * c[w] + 8 * (10 + 90 * n * documents // total))) for w in set(terms(text)) if c[w])
            if score > 0:
                scores.append((-score, i is None, i))
        found.update((item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1))
    return found


def ranks(spark, docs, items, **options):
    asked = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in items], "item_id long, text string, n long, id string, rank int")
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked(table(spark, docs), asked, **options).collect())


ITEMS = [(1, "one two THREE"), (2, None), (3, ""), (4, "!!"), (5, "spam line text"), (5, "spam line text"), (None, "Äöü äöü öü 漢字"), (7, "absent words only"),
         (8, " ".join(f"w{i}x{i % 13}" for i in range(900)))]


@pytest.mark.parametrize("k, pass_characters", [(10, 1 << 22), (2, 40)])
def test_ranks_against_all_documents(spark, k, pass_characters):
    random.seed(31)
    pool = [f"t{n}" for n in range(60)]
    docs = CASES + [(100 + n // 2, " ".join(random.choices(pool, k=random.randint(1, 40)))) for n in range(300)]
    items = ITEMS + [(10 + n, " ".join(random.choices(pool, k=6))) for n in range(40)]
    assert ranks(spark, docs, items, k=k, pass_characters=pass_characters) == brute_ranks(docs, items, k)


def test_ties_go_to_the_smallest_ids(spark):
    docs = [(n, "same words here") for n in range(400, 0, -1)] + [(None, "same words here")]
    assert ranks(spark, docs, [(1, "words")]) == Counter((1, n, n, next(iter(brute_ranks(docs, [(1, "words")], 1)))[3]) for n in range(1, 11))


def test_no_documents_or_items(spark):
    assert not ranks(spark, [], ITEMS) and lexical.ranked(empty(spark), empty(spark), item_id="doc_id").count() == 0
    assert not ranks(spark, CASES, [])


def test_bounds_prune_pairs_and_lose_nothing():
    random.seed(32)
    pool = np.arange(4000)
    corpus, weights = lexical.Corpus(2048, 2048 * 50), np.full(4000, 5000.0)
    item_terms = [np.sort(np.random.default_rng(n).choice(pool[n // 8 * 250:n // 8 * 250 + 250], 12, False)) for n in range(128)]
    batch, = lexical.item_batches(item_terms, weights)
    owner = np.repeat(np.arange(2048), 20)
    rng = np.random.default_rng(5)
    term = np.concatenate([np.sort(rng.choice(pool[n // 128 * 250:n // 128 * 250 + 250], 20, False)) for n in range(2048)])
    value = lexical.impacts(np.ones(len(term), np.int64), np.full(len(term), 50), corpus)
    dense = np.zeros((2048, 4000))
    dense[owner, term] = value
    exact = batch.vectors @ dense[:, batch.terms].T
    floors = np.sort(exact, axis=1)[:, -10]
    rows, docs, scores, scored = lexical.search_block(batch, owner, term, value, 2048, floors)
    kept = (exact >= floors[:, None]) & (exact > 0)
    assert set(zip(rows.tolist(), docs.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(kept))))
    assert (scores == exact[rows, docs]).all() and scored < exact.size / 8


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    # Words one edit apart have a word in common after one character has been taken out, or kept, on either side.
    cut = defaultdict(set)
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} if len(w) < 100 else {w}:
            cut[v].add(w)
    near = {w: [] for w in counts}
    for a, b in {(a, b) for group in cut.values() for a in group for b in group}:
        if one_edit(a, b):
            near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return Counter((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def variant_rows(spark, docs, **options):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table(spark, docs), **options).collect())


@pytest.mark.parametrize("options", [{}, {"part_symbols": 500, "half_words": 3}])
def test_variants_against_all_pairs(spark, options):
    random.seed(41)
    words = ["".join(random.choice("abcä") for _ in range(random.randint(7, 9))) for _ in range(120)] + ["Ångström", "ÅNGSTRÖM", "x÷y×zabcd", "y" * 3000]
    docs = list(CASES)
    for n in range(200):
        chosen = [w for w in random.choices(words, weights=[100 / (k + 1) for k in range(len(words))], k=60)]
        docs.append((100 + n, " ".join(w if random.random() > 0.1 else w[:3] + random.choice("abc") + w[3 + random.randint(0, 1):] for w in chosen)))
    expected = brute_variants(docs)
    assert sum(form is not None for _, form, *_ in expected) > 20 and any(root not in (w, form) for w, form, root, *_ in expected if form)
    assert variant_rows(spark, docs, **options) == expected


def test_variants_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert variant_rows(spark, docs) == brute_variants(docs)


def test_no_words(spark):
    assert spelling.variants(empty(spark)).count() == 0
    assert not variant_rows(spark, [(1, None), (2, "short words only")])

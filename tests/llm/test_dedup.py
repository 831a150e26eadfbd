from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from plumbline.llm import naming, simhash, suffix
from tests.llm.cases import CASES, LONG, empty, table


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("block_bytes", [7, 4096])
def test_exact_groups(spark, block_bytes):
    found = naming.exact_groups(table(spark), block_bytes=block_bytes).collect()
    groups = defaultdict(list)
    for i, text in CASES:
        groups[normal(text)].append(i)
    expected = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_blocks_that_differ_only_in_order_or_number(spark):
    pairs = [(i, t) for i, t in enumerate(["ab" * n for n in range(12)] + ["ba" * n for n in range(12)] + ["aabb", "abab", "aabb"])]
    found = naming.exact_groups(table(spark, pairs), block_bytes=2).collect()
    assert {r.doc_id: r.group_size for r in found if r.group_size > 1} == {0: 2, 12: 2, 2: 2, 25: 2, 24: 2, 26: 2}


def test_drop_exact_copies_keeps_columns_and_twins_once(spark):
    docs = table(spark)
    found = naming.drop_exact_copies(docs)
    assert found.columns == docs.columns
    assert Counter(normal(r.text) for r in found.collect()) == Counter({normal(t): 1 for _, t in CASES})


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_near_groups_against_all_pairs(spark):
    random.seed(5)
    base = " ".join(random.choice("alpha beta gamma delta eps zeta eta".split()) + str(random.randint(0, 99)) for _ in range(900))
    near = [(100 + i, base + " tail" * i) for i in range(6)] + [(200 + i, base.replace("9", "8", i)) for i in range(6)]
    docs = CASES + near
    found = simhash.near_groups(table(spark, docs)).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(prints):
        least[root(n)].append(i)
    expected = Counter((i, f"{f:016x}", min((x for x in least[root(n)] if x is not None), default=None)) for n, (i, f) in enumerate(prints))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    assert len({r.component_id for r in found if (r.doc_id or 0) >= 100}) < 12


def test_balls_and_components_against_all_pairs(spark):
    random.seed(7)
    seeds = [random.getrandbits(64) for _ in range(15)]
    values = {0, (1 << 64) - 1, *seeds}
    for s in seeds:
        for _ in range(8):
            s ^= 1 << random.randrange(64)
            values.add(s)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert {(r.a, r.b) for r in simhash.linked_pairs(frame).collect()} == pairs
    parent = {v: v for v in signed}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.fp: r.root for r in simhash.components(simhash.links(frame)).collect()}
    linked = {v for p in pairs for v in p}
    assert {v: found.get(v, v) for v in signed} == {v: root(v) for v in signed}
    assert linked - {root(v) for v in linked} <= set(found)
    with pytest.raises(ValueError):
        simhash.links(frame, 3)


def test_drop_near_copies(spark):
    docs = table(spark)
    found = simhash.drop_near_copies(docs)
    assert found.columns == docs.columns
    texts = [r.text for r in found.collect()]
    assert texts.count("one two three four five") == 1 and sum((t or "").startswith("w0x0 w1x1") for t in texts) == 1


def test_near_copies_are_judged_by_row_and_not_by_id(spark):
    docs = [(8, "a b c d e f"), (8, "an unrelated text under the same id"), (None, "A b c d e F"), (None, "null id, own text"), (9, "A B c d e f")]
    found = sorted(r.text for r in simhash.drop_near_copies(table(spark, docs)).collect())
    assert found == sorted([docs[0][1], docs[1][1], docs[3][1]])


def brute_repeats(docs, length):
    seen, found = set(), []
    for i, text in sorted(docs, key=lambda d: d[0]):
        data, covered = (text or "").encode(), np.zeros(len((text or "").encode()), bool)
        for s in range(len(data) - length + 1):
            if data[s:s + length] in seen:
                covered[s:s + length] = True
            seen.add(data[s:s + length])
        runs = int((np.diff(np.concatenate(([0], covered.astype(int), [0]))) == 1).sum())
        found.append((i, len(data), int(covered.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~covered])))
    return found


def repeated_documents():
    random.seed(11)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "ä", "ö", "x" * 40]
    passage = [" ".join(random.choice(words) + str(random.randint(0, 9)) for _ in range(random.randint(10, 60))) for _ in range(6)]
    docs = []
    for i in range(70):
        own = " ".join(str(random.randint(0, 10 ** 9)) for _ in range(random.randint(0, 40)))
        docs.append((i, own + random.choice(passage)[random.randint(0, 30):] + own[:50] + random.choice(passage)))
    return [*docs, (70, docs[3][1]), (71, docs[3][1]), (72, "x" * 1000), (73, "y" + "x" * 700), (74, None), (75, ""), (76, "ab" * 400)]


@pytest.mark.parametrize("large_group", [12_000, 3])
def test_repeated_spans_against_brute_force(spark, large_group):
    docs = repeated_documents()
    found = suffix.without_repeats(table(spark, docs), shard_stretches=40, large_group=large_group).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == brute_repeats(docs, 100)


def test_repeats_of_awkward_cases(spark):
    found = suffix.without_repeats(table(spark)).collect()
    assert len(found) == len(CASES)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[10].n_removed == len(LONG) + 1 and by_id[11].n_removed == 4999 and by_id[9].n_removed < by_id[10].n_removed
    assert bytes(by_id[10].kept) == b"end"  # the text before it, blank included, stands in document 9


def test_long_pieces_agree_with_one_piece(monkeypatch):
    data = b"".join(str(i * i).encode() for i in range(4000))
    whole = suffix.anchors(data)
    monkeypatch.setattr(suffix, "_PIECE", 501)
    assert all((a == b).all() for a, b in zip(suffix.anchors(data), whole))


def test_empty_tables(spark):
    docs = empty(spark)
    for found in (naming.exact_groups(docs), naming.drop_exact_copies(docs), simhash.near_groups(docs), simhash.drop_near_copies(docs),
                  suffix.without_repeats(docs)):
        assert found.count() == 0

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe, chat, licenses, mixing, quality, toxicity, urls
from tests.llm.cases import CASES, empty, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def test_ids_equal_the_library_and_round_trip(tokenizer):
    random.seed(1)
    odd = "aaaa AAAA\x1c\x1f\x85\u180e\u2009\u200b\t\n\r\x0b\x0c '''s 'LL<|endoftext|>x<|endo 漢字 😀👍🏽 ²³½Ⅷ٣ \ufffd"
    texts = [t or "" for _, t in CASES] + [odd, "ab" * 3000, "a" * 9000] + [
        "".join(random.choice(odd) for _ in range(random.randint(0, 60))) for _ in range(400)]
    vocabulary = bpe.Vocabulary(PATH)
    for known in (10 ** 6, 50):
        encoder = bpe.Encoder(vocabulary, known)
        found = [ids for at in range(0, len(texts), 100) for ids in encoder.encode(texts[at:at + 100])]
        assert [x.tolist() for x in found] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode_ids(x, vocabulary) for x in found] == texts
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([60_000]), vocabulary)


def test_tokens_column_and_decoding(spark, tokenizer):
    docs = table(spark)
    tokens = bpe.with_tokens(docs, PATH)
    assert tokens.columns == [*docs.columns, "tokens"]
    assert Counter((r.text, tuple(r.tokens)) for r in tokens.collect()) == Counter(
        (t, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for _, t in CASES)
    assert Counter(r.text for r in bpe.decoded(tokens, PATH).collect()) == Counter(t or "" for _, t in CASES)
    assert bpe.digests(docs, PATH).count() == len(CASES)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    random.seed(2)
    parts = ["\\", "#", "##", "###", "</turn>", "<", "/turn>", "\n", ": ", ":", " ", "ä", "### user: ", "x", "\\/"]
    rows = [(c, t, random.choice(["user", "assistant", "a: b:", "", "#\\", None]), "".join(random.choices(parts, k=random.randint(0, 12))) or None)
            for c in range(30) for t in range(random.randint(1, 9))]
    rows += [(None, 0, "user", "null id"), (50, 3, "user", "b"), (50, 3, "user", "a"), (50, None, None, None), (51, 0, "user", "y" * 200_000)]
    done = chat.formatted(chat.linear_messages(conversations(spark, rows)))
    got = {r.tree: (r.turns, r.learnt) for r in done.select("tree", chat.parsed(done.formatted).alias("turns"),
                                                            chat.learnt_text(done.formatted, done.loss_spans).alias("learnt")).collect()}
    expected = {}
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        expected.setdefault("" if c is None else f"={c}", []).append((role or "", text or ""))
    assert {k: [tuple(x) for x in v[0]] for k, v in got.items()} == expected
    assert {k: v[1] for k, v in got.items()} == {k: "".join(t for r, t in v if r == "assistant") for k, v in expected.items()}


def test_reply_trees_against_a_walk(spark):
    random.seed(4)
    messages = []
    for tree in "abc":
        for i in range(60):
            parent = None if i == 0 else random.randrange(i) if i % 7 else i - 1
            messages.append((tree, i, parent, float(random.randint(0, 3)), random.choice(["user", "assistant"]), f"{tree}{i}"))
    messages += [("d", 1, 99, 1.0, "user", "orphan"), ("e", 1, 2, 1.0, "user", "cycle"), ("e", 2, 1, 1.0, "user", "cycle"), ("e", 3, None, 0.0, "user", "root")]
    frame = spark.createDataFrame(messages, "tree string, id long, parent long, score double, role string, text string")
    got = {}
    for r in chat.chosen_paths(frame, best=3).collect():
        got.setdefault((r.tree, r["rank"]), []).append((r.distance, r.id))
    expected = {}
    for tree in "abcde":
        own = {m[1]: m for m in messages if m[0] == tree}
        paths = []
        for leaf in set(own) - {m[2] for m in own.values()}:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            paths.append((-sum(own[i][3] for i in path), -len(path), leaf, path))
        for rank, p in enumerate(sorted(paths)[:3], 1):
            expected[(tree, rank)] = list(enumerate(p[3]))
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_mixed_budget_is_exact(spark):
    found = mixing.mixed(table(spark), range_rows=2).collect()
    assert len(found) == len(CASES) and all(0 <= r.taken <= 2 * r["size"] for r in found)
    sums = Counter()
    for r in found:
        sums[(r.source_size, r.target)] += r.taken
    assert all(int(target) == taken or size == 0 for (size, target), taken in sums.items())
    assert sum(sums.values()) == pytest.approx(1.5 * sum(r["size"] for r in found), abs=4)
    assert Counter(found) == Counter(mixing.mixed(table(spark), range_rows=4096).collect())


def test_mix_emits_what_it_takes(spark):
    docs = table(spark)
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, emitted = Counter(), Counter()
    for r in mixing.mixed(docs).collect():
        taken[r.id] += r.taken
    for r in mix.collect():
        emitted[r.doc_id] += count(r.text)
        assert r.n_chars == len(r.text)
    assert +taken == +emitted


def test_mix_keeps_rows_apart_that_share_id_and_text(spark):
    rows = [(1, "a b c", "s0", "first"), (1, "a b c", "s1", "second"), (1, "a b c", "s1", "third"), (2, "d e f g", "s0", "fourth"), (None, "h", None, "fifth")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    sizes, goals = Counter(), {}
    for r in mixing.mixed(docs).collect():
        goals[(r.source_size, r.target)] = goals.get((r.source_size, r.target), 0) + r.taken
    for r in mixing.mix(docs, range_rows=2).collect():
        assert (r.doc_id, r.source, r.note) in {(i, s, n) for i, _, s, n in rows}
        sizes[r.source] += len(r.text.split())
    assert Counter(sizes.values()) == Counter(goals.values()) and set(sizes) == {"s0", "s1", None}
    assert all(int(target) == taken for (_, target), taken in goals.items())


def test_cutoffs_hold_only_what_the_binomial_proves(spark):
    from math import comb
    frame = spark.createDataFrame([(float(n), float(k)) for n, k in ((200, 0), (200, 1), (500, 3), (5, 0), (1000, 9), (0, 0), (100_000, 900))], "n double, k double")
    got = frame.select("n", "k", quality.binomial_tail(frame.n, frame.k, 0.01).alias("p")).collect()
    for r in got:
        if r.n <= 1000:
            exact = 1.0 if r.k >= r.n * 0.01 else sum(comb(int(r.n), j) * 0.01 ** j * 0.99 ** (r.n - j) for j in range(int(r.k) + 1))
            assert r.p == pytest.approx(exact, rel=1e-9)
    assert 0 < got[-1].p < 0.01


def test_false_rejection_is_limited(spark):
    random.seed(9)
    texts, labels = [], []
    for i in range(6000):
        good = i % 4 > 0
        words = [f"w{random.randint(0, 10 ** 6)}" for _ in range(60)]
        if not good or random.random() < 0.002:
            words = [w + "***" for w in words]
        texts.append((i, " ".join(words)))
        labels += [(i, int(good)), (i, int(good))] if i % 5 == 0 else [(i, int(good))]
    labels += [(None, 1), (99_999, 1), (5, None)]
    label_table = spark.createDataFrame(labels, "doc_id long, quality int")
    judged = {r.doc_id: r for r in quality.judged(table(spark, texts), label_table).collect()}
    bad = [i for i in range(6000) if i % 4 == 0]
    assert sum(not judged[i].kept for i in bad) > 0.6 * len(bad)
    assert sum(not judged[i].kept for i in range(6000) if i % 4) < 0.05 * 4500
    none = quality.judged(table(spark, texts), label_table.where("false")).where("NOT kept").count()
    assert none == 0


def test_quality_of_awkward_cases(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    docs = table(spark)
    found = quality.judged(docs, labels).collect()
    assert len(found) == len(CASES)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert (by_id[13].n_words, by_id[13].n_repeat_words, by_id[13].base_failed) == (180, 180, True)
    assert (by_id[12].n_dup_lines, by_id[2].n_words, by_id[9].n_words) == (2, 0, 30_000)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def test_license_spans(spark):
    gpl = licenses.TEMPLATES[5][1].split()
    texts = [(0, "Intro. " + " ".join(gpl) + " outro"), (1, "x " + " ".join(gpl[:10] + ["very"] + gpl[10:]) + " y"), (2, " ".join(gpl[:8])),
             (3, "Permission is HEREBY granted"), (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, "mit license, MIT-License"), (6, "mit license, MIT-License"),
             (7, "M\u0130T LICENSE \u212aelvin \u00c9")]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scanned(table(spark, texts)).collect()}
    assert got[0][4:] == ("gpl", "gpl", 1.0) and got[1][4:6] == ("gpl", "gpl") and got[2][5] == "" and got[3][5] == ""
    assert got[4] == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0) and got[5] == (0, 0, None, None, "", "", 0.0)
    assert got[6] == (4, 2, 0, 2, "mit", "mit", 1.0) and got[7][:2] == (4, 0)
    spans = {r.id: (r.first, r.last) for r in licenses.spans(table(spark, texts)).where("template = 5").collect()}
    assert spans[0] == (1, len(gpl)) and spans[1] == (1, len(gpl) + 1)


def test_a_replaced_or_inserted_word_is_forgiven_in_every_template(spark):
    texts, expected = [], {}
    for n, (label, notice, needs) in enumerate(licenses.TEMPLATES):
        words = notice.split()
        middle = len(words) // 2
        at = next(i for i in sorted(range(len(words)), key=lambda i: abs(i - middle)) if words[i] != needs)
        for k, changed in enumerate((words, words[:at] + ["another"] + words[at + 1:], words[:middle] + ["inserted"] + words[middle:])):
            texts.append((10 * n + k, "some words before. " + " ".join(changed) + "! some words after"))
            expected[10 * n + k] = label
        # Without its distinguishing word, or with that of a close license, a notice isn't this license.
        texts.append((10 * n + 3, " ".join("other" if w == needs else w for w in words)))
    texts += [(9000, "Licensed under CC BY 4.0"), (9001, "Licensed under CC BY-SA 3.0"), (9002, "licensed under cc by nd 4 0")]
    found = {r.doc_id: set(r.labels.split(",")) for r in licenses.scanned(table(spark, texts)).collect()}
    assert all(label in found[i] for i, label in expected.items())
    shared = {n for n, (label, _, _) in enumerate(licenses.TEMPLATES) if licenses.PHRASES.get(next((p for p in licenses.PHRASES if p in licenses.TEMPLATES[n][1]), "")) == label}
    assert all(licenses.TEMPLATES[n][0] not in found[10 * n + 3] for n in range(len(licenses.TEMPLATES)) if n not in shared)
    assert found[9000] == {"cc-by"} and found[9001] == {"cc-by", "cc-by-sa"} and found[9002] == {"cc-by", "cc-by-nd"}
    assert len(licenses.TEMPLATES) >= 30


def test_url_parts_and_rules(spark):
    cases = ["http://A.Example.NET/en/1?x", "https://net", "http://net/", "ftp://x.net?q#/", "no scheme", None, "", "a://b://c/d", "http://org/fr/",
             "http://xexample.com/de/", "http://www.example.com/de/x#y/z", "http://h#f", "x://Ä.NET/en/", "http://example.net/en"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    got = [(r.host, r.path, r.rule) for r in urls.judged(pages).orderBy("page_id").collect()]
    assert got == [("a.example.net", "/en/1", "example.net/en/"), ("net", "", None), ("net", "/", "net/"), ("x.net", "", None), ("", "", None),
                   ("", "", None), ("", "", None), ("b:", "//c/d", None), ("org", "/fr/", "org/fr/"), ("xexample.com", "/de/", None),
                   ("www.example.com", "/de/x", "example.com/de/"), ("h", "", None), ("Ä.net", "/en/", "net/"), ("example.net", "/en", "net/")]


def test_url_models_part_held_out_urls(spark):
    random.seed(3)
    name = lambda letters: "".join(random.choice(letters) for _ in range(8))
    known = [(i, f"http://{name('abcd')}.org/fr/{name('abcd')}" if i % 2 else f"http://{name('xyzw')}.net/{name('xyzw')}") for i in range(600)]
    new = [(1000 + i, f"http://{name('abcd' if i % 2 else 'xyzw')}.com/{name('abcd' if i % 2 else 'xyzw')}") for i in range(100)]
    pages = spark.createDataFrame(known + new, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(pages).where("page_id >= 1000").collect()}
    assert sum(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(100)) > 95


def test_toxicity_on_held_out_rows(spark):
    random.seed(6)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(2000)]
    bad = ["nasty", "vileness", "rotten"]
    texts, labels = [], []
    for i in range(900):
        text = random.choices(words, k=random.randint(20, 200))
        if i % 4 == 0:
            text[random.randrange(len(text))] = random.choice(bad) + random.choice(["", ".", "!"])
        texts.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    label_table = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.scored(table(spark, texts), label_table).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in found]) > 0.95
    again = toxicity.scored(table(spark, CASES), label_table).collect()
    assert len(again) == len(CASES) and all(0 <= r.score <= 1 for r in again)
    # A shared label table, and one labelled id in many rows: the sample is drawn from rows of this table, one an id.
    foreign = spark.range(10_000, 2_010_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").unionByName(label_table)
    many = table(spark, texts).unionByName(table(spark, [texts[0]] * 3000))
    assert Counter(toxicity.scored(many, foreign).where("held_out").select("doc_id", "predicted").distinct().collect()) == Counter(
        (r.doc_id, r.predicted) for r in found)
    assert len(toxicity._sample(many, foreign, "doc_id", "text", "lang", "doc_id", "toxic")[0]) == sum(crc32(str(i).encode()) % 3 != 1 for i in range(900))
    unlabelled = toxicity.scored(table(spark), label_table.where("false")).collect()
    assert {r.score for r in unlabelled} == {0.0}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """The one sign of a class stands at the end of texts over 20,000 characters, and 6,000 plain texts a class hide few others."""
    monkeypatch.setattr(toxicity, "PART", 600_000)
    random.seed(11)
    filler = " ".join(random.choices(["plain", "words", "of", "no", "weight"], k=4200))
    texts = [(i, f"{filler} {'venom' if i % 2 else 'honey'}") for i in range(120)]
    short = [(1000 + i, f"w{random.randint(0, 300)} w{random.randint(0, 300)}") for i in range(12000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts + short], "doc_id long, toxic int")
    docs = table(spark, texts + short)
    usable = [(i, t) for i, t in texts + short if crc32(str(i).encode()) % 3 != 1]
    rows = toxicity._labelled(docs, labels, "doc_id", "text", "lang", "doc_id", "toxic")
    assert rows.count() == len(usable)
    seen = toxicity._seen(rows)
    for n, word in enumerate(("honey", "venom")):
        bucket = toxicity.buckets([word.encode()])[0, 0]
        assert seen[n, bucket] == sum(f" {word}" in t for _, t in usable)
    model, _ = toxicity.fitted(docs, labels)
    low, high = model.logits([toxicity.words_of(f"{filler} {w}".encode()) for w in ("honey", "venom")])
    assert high > low + 0.5


def test_texts_are_scored_alike_alone_and_together():
    random.seed(8)
    words = [f"w{i}".encode() for i in range(300)]
    texts = [[*random.choices(words, k=random.randint(0, 60)), *[b""] * 2] or [b""] * 3 for _ in range(50)]
    texts = [t if len(t) > 2 else [b""] * 3 for t in texts]
    model = toxicity.trained([toxicity.buckets(t) for t in texts], np.arange(50) % 2)
    assert np.allclose(model.logits(texts), [model.logits([t])[0] for t in texts], atol=1e-4)


def test_convolution_and_gradients_against_plain_loops():
    random.seed(9)
    texts = [toxicity.buckets([f"w{random.randint(0, 40)}".encode() for _ in range(random.randint(1, 12))] + [b""] * 2) for _ in range(6)]
    labels = np.array([0, 1, 0, 1, 1, 0])
    model = toxicity.trained(texts * 5, np.tile(labels, 5))
    rng, words = np.random.default_rng(3), [[b"w1", b"w2", b"w3", b""], [b"w9", b"", b""]]
    for text in words + [[b"w5", b"", b""]]:
        rows = model.table[toxicity.buckets(text)].sum(axis=1)
        pooled = [max(sum(rows[at + j] @ f[j, :, k] for j in range(len(f))) for at in range(len(text) - 2)) for f in model.filters for k in range(f.shape[2])]
        assert np.isclose(np.maximum(np.array(pooled) + model.bias, 0) @ model.output + model.constant, model.logits([text])[0], atol=1e-4)
    parts = [p.astype(np.float64) for p in (model.table, *model.filters, model.bias + 0.05, model.output, np.array([model.constant]))]
    weight = np.linspace(0.5, 1.5, len(texts))

    def loss(table_, f1, f2, f3, bias, output, constant):
        total = 0.0
        for text, label, w in zip(texts, labels, weight):
            rows = table_[text].sum(axis=1)
            pooled = np.concatenate([np.max([sum(rows[at + j] @ f[j] for j in range(len(f))) for at in range(len(text) - 2)], axis=0) for f in (f1, f2, f3)])
            logit = np.maximum(pooled + bias, 0) @ output + constant[0]
            total += w * (np.log1p(np.exp(-abs(logit))) + max(logit, 0) - label * logit)
        return total / len(texts)
    touched, gradients = toxicity._gradients(texts, labels, weight, parts[0], parts[1:4], *parts[4:])
    for n, gradient in enumerate(gradients):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in gradient.shape)
            place = (touched[at[0]], *at[1:]) if n == 0 else at
            sides = []
            for step in (1e-5, -1e-5):
                moved = [p.copy() for p in parts]
                moved[n][place] += step
                sides.append(loss(*moved))
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(gradient[at], abs=1e-4)


def test_empty_tables(spark):
    docs = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    turns = conversations(spark, [])
    for found in (bpe.with_tokens(docs, PATH), bpe.digests(docs, PATH), mixing.mixed(docs), mixing.mix(docs), quality.judged(docs, labels),
                  quality.keep_good(docs, labels), licenses.scanned(docs), urls.judged(pages), toxicity.scored(docs, labels),
                  chat.formatted(chat.linear_messages(turns))):
        assert found.count() == 0

"""Drift, rules and labels against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from plumbline.operators import checks, summaries, unify
from plumbline.operators.checks import Dependency, Reference, RowRule
from plumbline.operators.components import components
from plumbline.sources.staging import staged, staged_path
from plumbline.sources.tables import read_sources


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_summaries_of_parts_add_up(spark):
    random.seed(1)
    data = [(n, random.choice([None, float("nan"), float("inf"), -math.inf, -0.0, 1e300, random.gauss(0, 5)]), random.choice([None, "", "a", "ä" * 50]),
             random.choice([True, False, None]), [n % 3, None]) for n in range(400)]
    df = spark.createDataFrame(data, "i long, x double, s string, b boolean, a array<int>")
    from plumbline.operators.columns import normalise
    df = normalise(df)
    whole = summaries.summarise(df, "t")
    parts = [summaries.summarise(df.where(f"i % 3 = {k}"), "t") for k in range(3)]
    assert rows(summaries.merged(*parts)) == rows(whole.select(summaries.merged(whole).columns))
    places = {r.place for r in whole.where("column = 'x'").collect()}
    assert sorted(round(math.log10(p)) if p < math.inf else p for p in places if p is not None and p > 1e200) == [290, math.inf] and {None, -math.inf, 0.0} <= places
    assert all(r.n == 400 for r in whole.groupBy("column").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect())


def test_drift_against_plain_numbers(spark):
    random.seed(2)
    base, other = [random.gauss(0, 1) for _ in range(800)], [random.gauss(0.7, 1.5) for _ in range(500)]
    schema = "x double, k string"
    left, right = (spark.createDataFrame([(v, f"k{int(abs(v))}") for v in values], schema) for values in (base, other))
    found = {r.column: r for r in summaries.drift(staged(summaries.merged(summaries.summarise(left, "a"), summaries.summarise(right, "b")), "s"), "a").collect()}
    points = sorted(base + other)
    largest = max(abs(sum(v <= p for v in base) / 800 - sum(v <= p for v in other) / 500) for p in points)
    assert found["x"].distance == pytest.approx(largest, abs=0.003) and found["x"].level == "drifted"
    p, q = Counter(int(abs(v)) for v in base), Counter(int(abs(v)) for v in other)
    kinds = set(p) | set(q)
    assert found["k"].distance == pytest.approx(sum(abs(p[k] / 800 - q[k] / 500) for k in kinds) / 2)
    shares = [((p[k] + .5) / (800 + .5 * len(kinds)), (q[k] + .5) / (500 + .5 * len(kinds))) for k in kinds]
    assert found["k"].psi == pytest.approx(sum((a - b) * math.log(a / b) for a, b in shares))
    same = summaries.compare(summaries.merged(summaries.summarise(left, "a"), summaries.summarise(left, "b")), "a").collect()
    assert all(r.schema == "same" and r.psi == 0 and r.distance == 0 and r.level == "stable" for r in same)


def test_columns_of_one_side_and_empty_sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "i long, only_left string")
    right = spark.createDataFrame([("x", 1.0)], "i string, only_right double").where("false")
    found = {r.column: r for r in summaries.compare(summaries.merged(
        summaries.summarise(left, "l"), summaries.summarise(right.unionByName(spark.createDataFrame([(None, 2.0)], right.schema)), "r")), "l").collect()}
    assert {c: r.schema for c, r in found.items()} == {"i": "other kind", "only_left": "missing", "only_right": "added"}
    assert found["i"].null_share == 1 and found["i"].psi is None


def test_reading_several_files(spark):
    one, two = staged_path(spark, "one.parquet"), staged_path(spark, "two.parquet")
    spark.createDataFrame([(1, "a")], "i int, s string").write.parquet(one)
    spark.createDataFrame([(2, 0.5)], "i long, x double").write.parquet(two)
    assert rows(read_sources(spark, {"1": one, "2": two}).select("i", "s", "x", "source")) == Counter([(1, "a", None, "1"), (2, None, 0.5, "2")])
    assert {r.source for r in read_sources(spark, [one, two]).collect()} == {one, two}
    with pytest.raises(ValueError):
        read_sources(spark, [])


def table_of(spark, data):
    return spark.createDataFrame(data, "id long, g string, v string, x double")


def test_rules_against_plain_python(spark):
    random.seed(3)
    data = [(n, random.choice(["a", "b", "c", None]), random.choice(["p", "q", None]), random.choice([1.0, -1.0, None])) for n in range(300)]
    df = table_of(spark, data)
    target = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    rules = [RowRule("positive", "x > 0"), RowRule("small", "id < 250"), RowRule("null", "CAST(NULL AS BOOLEAN)"),
             Reference("ref", ("g",), "t", ("t",)), Dependency("dep", ("g",), "v")]
    found = {r.rule: (r.checked, r.broken, r.passed) for r in checks.check_rules(df, rules, {"t": target}).collect()}
    groups = defaultdict(Counter)
    for _, g, v, _ in data:
        groups[g][v] += 1
    assert found == {
        "positive": (sum(x is not None for *_, x in data), sum(x == -1 for *_, x in data), False), "small": (300, 50, False), "null": (0, 0, True),
        "ref": (sum(g is not None for _, g, *_ in data), sum(g == "c" for _, g, *_ in data), False),
        "dep": (300, sum(c.total() - max(c.values()) for c in groups.values()), False)}
    best = {g: min(c, key=lambda v: (-c[v], v is None, v or "")) for g, c in groups.items()}
    assert rows(checks.broken_dependency_rows(df, rules[-1])) == Counter(r for r in data if r[2] != best[r[1]])
    marked = checks.broken_rows(df, rules[:3]).collect()
    assert {r.id: r.broken_rules for r in marked} == {n: [m for m, bad in (("positive", x == -1), ("small", n >= 250)) if bad]
                                                      for n, _, _, x in data if x == -1 or n >= 250}


def test_the_number_of_conditions_does_not_change_the_number_of_scans(spark):
    path = staged_path(spark, "t.parquet")
    table_of(spark, [(1, "a", "b", 0.5)]).write.parquet(path)
    df = spark.read.parquet(path)
    for n in (1, 40):
        plan = checks._row_results(df, [RowRule(f"r{k}", f"id > {k}") for k in range(n)])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and plan.count("Aggregate") == 1


def test_rules_on_no_rows_and_wrong_rules(spark):
    df = table_of(spark, [])
    rules = [RowRule("positive", "x > 0"), Reference("ref", ("g",), "t", ("g",)), Dependency("dep", ("g",), "v")]
    assert all((r.checked, r.broken, r.broken_share, r.passed) == (0, 0, 0.0, True) for r in checks.check_rules(df, rules, {"t": df}).collect())
    assert checks.check_rules(df, []).count() == 0
    with pytest.raises(ValueError):
        checks.check_rules(df, [rules[0], rules[0]])


def test_fixes_follow_each_other(spark):
    df = table_of(spark, [(1, "a", "b", -1.0), (2, "a", "b", None), (3, None, "b", 5.0)])
    rules = [RowRule("sign", "x >= 0", fix=(("x", "-x"), ("v", "'fixed'"))), RowRule("g", "g IS NOT NULL", fix=checks.DROP), RowRule("one", "x <> 1", fix=checks.DROP)]
    assert rows(checks.apply_fixes(df, rules)) == Counter([(2, "a", "b", None)])


def test_components_against_plain_search(spark):
    random.seed(4)
    links = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(110)] + [(n, n + 1) for n in range(1000, 1060)] + [(5000, n) for n in range(5001, 5100)]
    parent = {n: n for pair in links for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: root(n) for n in parent if any(a != b and n in (a, b) for a, b in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_labels_against_all_pairs(spark):
    random.seed(5)
    words = ["north", "south", "northern", "Köln", "A-1001", "A-1002", "abcd", "abce", "x" * 70, "x" * 71, ""]
    values = []
    for _ in range(500):
        w = random.choice(words)
        at = random.randint(0, max(len(w) - 1, 0))
        w = random.choice([w, w, w, w.upper(), f" {w} ", w[:at] + w[at + 1:], w[:at] + random.choice("xyz") + w[at:]])
        values.append((w if random.random() > 0.05 else None,))
    counts = Counter(v for v, in values if v is not None)
    plain = {v: " ".join(v.lower().split(" ")).strip(" ") for v in counts}
    forms = sorted(set(plain.values()))
    fuzzy = [f for f in forms if 5 <= len(f) <= 64 and not any(c.isdigit() for c in f)]
    group = {f: f for f in forms}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f
    for a in fuzzy:
        for b in fuzzy:
            if a < b and edits(a, b) <= 1:
                group[root(b)] = root(a)
    best = {}
    for v in counts:
        best.setdefault(root(plain[v]), []).append((-counts[v], v))
    df = spark.createDataFrame(values, "label string")
    expected = Counter(("label", v, n, min(best[root(plain[v])])[1]) for v, n in counts.items())
    assert rows(unify.label_map(df)) == expected and len({u for *_, u in expected}) < len(counts) - 10
    changed = {v: u for _, v, _, u in expected}
    assert rows(unify.unify_labels(df)) == Counter((changed.get(v),) for v, in values)
    assert unify.unify_labels(df.where("false")).count() == 0

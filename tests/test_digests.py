"""Counting by digest and row dedup by digest against plain Python, and what their plans shuffle."""

from __future__ import annotations

import random
from collections import Counter

from plumbline.operators import clean, duplicates, frequencies
from plumbline.operators.columns import table_columns


def test_top_values_and_modes_of_long_texts(spark):
    random.seed(1)
    head = "x" * 70
    pool = ["", "a", "b", "z" * 64, "z" * 65, *[head + str(n) for n in range(40)], *[f"{n}" * 80 for n in range(10)], "é" * 40]
    data = [(random.choice([None, *pool]), random.choice(pool[5:9]), n % 5, n % 2 == 0, head + str(n)) for n in range(700)]
    df = spark.createDataFrame(data, "many string, few string, i int, b boolean, own string")
    for k in (1, 3, 50):
        found = Counter(tuple(r) for r in frequencies.top_values(df, table_columns(df), k).collect())
        expected = Counter()
        for at, name in enumerate(df.columns):
            text = (lambda v: str(v).lower() if isinstance(v, bool) else str(v))
            counts = Counter(text(r[at]) for r in data if r[at] is not None)
            expected.update((name, rank, v, n) for rank, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k], 1))
        assert found == expected
        if k == 1:
            distinct = {name: len({r[at] for r in data if r[at] is not None}) for at, name in enumerate(df.columns)}
            modes = Counter(tuple(r) for r in frequencies.modes(df, table_columns(df)).collect())
            assert modes == Counter((name, distinct[name], v, n) for name, _, v, n in expected)
    assert frequencies.modes(df.where("false"), table_columns(df)).count() == 0


def test_no_long_text_is_shuffled_for_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = frequencies._key_counts(df, table_columns(df, "string"))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(slot" in line and "value" in line for line in exchanges)
    schema = frequencies._key_counts(df, table_columns(df, "string")).schema["value"].dataType
    assert schema.names == ["head", "digest"]
    longest = frequencies._key_counts(df, table_columns(df, "string")).selectExpr("max(char_length(value.head))", "max(char_length(value.digest))").first()
    assert tuple(longest) == (64, 64)


def test_equal_rows_are_found_whatever_their_form(spark):
    nan = float("nan")
    data = [(0.0, "a", {"k": 1, "l": 2}), (-0.0, "a", {"l": 2, "k": 1}), (nan, "a", None), (nan, "a", None), (None, None, None), (None, None, None), (1.0, "b", {"k": 2}),
            (1.0, "b", {"k": 3}), (2.0, "c", None)]
    df = spark.createDataFrame(data, "x double, s string, m map<string,int>")
    found = clean.drop_duplicate_rows(df).collect()
    assert len(found) == 6 and Counter(r.s for r in found) == Counter({"a": 2, "b": 2, "c": 1, None: 1})
    flat = df.select("x", "s")
    assert clean.drop_duplicate_rows(flat).count() == flat.distinct().count() == 5
    assert [r.copies for r in duplicates.duplicate_members(flat.where("s IS NOT NULL"), ["s", "x"]).collect()] == [2] * 6


def test_rows_without_a_copy_are_not_shuffled(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    _, single = duplicates.repeated_and_single(df)
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "hashpartitioning" not in plan


def test_digests_beyond_the_bound_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BROADCAST_DIGESTS", 1)
    df = spark.createDataFrame([(n % 3, "a") for n in range(9)], "i int, s string")
    assert duplicates.repeated_and_single(df) == (None, None)
    assert clean.drop_duplicate_rows(df).count() == 3


def test_histogram_counts_infinities_apart(spark):
    from plumbline.operators import explore
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("-inf"),), (None,)], "v double")
    found = {r.bin: (r.low, r.high, r.n) for r in explore.histogram(df, ["v"]).collect()}
    assert found == {0: (float("-inf"), float("-inf"), 1), 1: (1.0, 1.5, 1), 2: (1.5, 2.0, 1), 3: (float("inf"), float("inf"), 1)}

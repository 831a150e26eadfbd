from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import rules
from plumbline.operators import (
    accuracy, clean, consistency, correlation, duplicates, explore, frequencies, missing, quantiles, structure, uniqueness,
    validity,
)
from plumbline.operators.columns import table_columns
from plumbline.plans.audit import audit
from plumbline.plans.scores import normalised_weights, quick_score


def numbers(seed: int, n: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 10, n)
    x[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"x": x, "steps": rng.integers(0, 4, n).astype(float),
                         "wide": np.exp(rng.normal(0, 4, n)), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.random(n))})


@pytest.mark.parametrize("limit", [20_000, 50])
def test_quantiles_are_exact(spark, monkeypatch, limit):
    """With a low limit the narrowing rounds run; both ways equal pandas."""
    monkeypatch.setattr(quantiles, "GATHER_LIMIT", limit)
    monkeypatch.setattr(quantiles, "SMALLEST_SAMPLE", 400)
    pdf = numbers(3, 3000)
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in pdf])
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = quantiles.exact_quantiles(df, table_columns(df), probs)
    for name in pdf:
        assert found[name] == pytest.approx(pdf[name].quantile(probs).tolist()), name


def test_quantiles_of_empty_and_single_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    assert quantiles.exact_quantiles(df, table_columns(df), [0.5]) == {"a": [None], "b": [1.0]}


def test_boxes_have_few_copies_on_cell_borders(spark):
    from plumbline.operators import duplicates
    xs = [f"x{i}" for i in range(14)]
    border = 0.5 * duplicates.COARSE_WIDTH
    boxes = spark.range(20).select(F.lit(1).alias("rows"), *[
        (F.lit(border) + F.col("id") * duplicates.COARSE_WIDTH * int(i == 0)).alias(f"{end}_{x}") for i, x in enumerate(xs) for end in ("lo", "hi")])
    for key in duplicates._key_groups(boxes, xs):
        assert duplicates._placed(boxes, key, duplicates.COARSE_WIDTH, 1e-6).count() <= 8 * 20


@pytest.mark.parametrize("k", [1, 2, 5])
def test_crowded_cells_move_on_to_other_columns(spark, monkeypatch, k):
    from plumbline.operators import duplicates
    monkeypatch.setattr(duplicates, "CROWDED_CELL", 4)
    rng = np.random.default_rng(k)
    rows = rng.integers(0, 3, (120, k)) * 1e-4 + rng.integers(0, 4, (120, k)) * 0.6e-6
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"c{i} double" for i in range(k)))
    apart = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, 1)
    assert duplicates.near_duplicates(df).first().near_rows == int((apart.min(axis=1) < 1e-6).sum())


def brute_near(rows, distance=1e-6):
    x = np.array(rows, dtype=float)
    apart = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    return int((apart.min(axis=1) < distance).sum())


def near(spark, rows):
    schema = ", ".join(f"c{i} double" for i in range(len(rows[0])))
    return duplicates.near_duplicates(spark.createDataFrame([tuple(map(float, r)) for r in rows], schema)).first()


def test_near_rows_hand_made(spark):
    rows = [(1, 1), (1 + 1e-7, 1), (2, 2), (2 + 1e-5, 2), (3, 3), (3, 3), (4, 4), (0.00005, 1), (0.0000504, 1)]
    assert near(spark, rows).near_rows == brute_near(rows) == 6


@pytest.mark.parametrize("dimensions, scale, n", [(1, 2e-4, 300), (2, 2e-5, 600), (3, 6e-6, 500)])
def test_near_rows_in_crowded_space(spark, dimensions, scale, n):
    """Points so dense that cells are crowded and boxes hold several points."""
    rng = np.random.default_rng(dimensions)
    rows = np.vstack([rng.random((n, dimensions)) * scale, rng.random((20, dimensions)) * 100]).tolist()
    assert near(spark, rows).near_rows == brute_near(rows)


def test_near_rows_leave_out_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 5.0)], "a double, b double")
    row = duplicates.near_duplicates(df).first()
    assert (row.n_rows, row.near_rows) == (1, 0)


def test_identical_columns_compare_rows(spark):
    # b holds the values of a in another order: same fingerprint, different rows.
    df = spark.createDataFrame([(1, 2, 1, None), (2, 1, 2, 1)], "a int, b int, c int, d int")
    assert [tuple(r) for r in duplicates.identical_columns(df).collect()] == [("a", "c")]


def test_duplicates_with_nulls_and_long_text(spark):
    long = "t" * 500
    df = spark.createDataFrame([(long, None), (long, None), (long + "x", None), (None, None), (None, None)], "a string, b int")
    row = duplicates.duplicate_counts(df).first()
    assert (row.n_rows, row.n_distinct_rows, row.duplicate_rows) == (5, 3, 2)


def test_distinct_counts_of_all_types(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0D, 1, true, DATE'2024-01-01', array(1), 'a'), (-0.0D, 2, true, null, array(1), 'a'), "
                   "(1.5D, 2, false, DATE'2024-01-02', null, null) t(d, i, b, t, arr, s)")
    found = {r.column: r.n_distinct for r in frequencies.distinct_counts(df).collect()}
    assert found == {"d": 2, "i": 2, "b": 2, "t": 2, "arr": 1, "s": 1}
    nearly = {r.column: r.n_distinct for r in frequencies.distinct_counts(df, approx=True).collect()}
    assert nearly == found


def test_mode_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    assert frequencies.modes(df, table_columns(df)).first().asDict() == {"column": "s", "n_distinct": 2, "mode": "a", "n": 2}


def test_correlations_match_pandas(spark):
    pdf = numbers(5, 400)
    pdf["flat"] = 3.3
    pdf["twice"] = pdf["x"] * 2 + 1
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in pdf])
    expected = pdf.corr()
    for row in correlation.correlations(df).collect():
        r = expected.loc[row.column_a, row.column_b]
        assert row.r is None if np.isnan(r) else row.r == pytest.approx(r), row


def test_label_noise_and_case(spark):
    values = ["Yes", "yes", "ye", "no", "nope", "N", "no ", None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    from plumbline.operators.labels import label_stats
    row = label_stats(df).first()
    assert (row.n_values, row.n_stripped, row.n_labels, row.noisy_labels) == (7, 6, 5, 2)
    assert consistency.case_issues(df, rules.AUDIT).first().extra_labels == 1
    assert accuracy.noisy_labels(label_stats(df)).first().noisy_labels == 2


@pytest.mark.parametrize("n, found", [(17, False), (18, True)])
def test_dominant_class_threshold(spark, n, found):
    df = spark.createDataFrame([("a",)] * n + [("b",)] * (20 - n) + [(None,)] * 5, "s string")
    rows = accuracy.imbalanced_columns(df).collect()
    assert bool(rows) is found
    if found:
        assert (rows[0].dominant_class, rows[0].n_classes) == ("a", 2)


def test_one_class_is_not_imbalanced(spark):
    assert accuracy.imbalanced_columns(spark.createDataFrame([("a",)] * 9, "s string")).count() == 0


def test_impossible_values_by_name(spark):
    df = spark.createDataFrame([(-1, 200.0, 0), (50, 50.0, 13), (151, -3.0, 6), (1, 1.0, 12)], "percentage int, rate double, month int")
    found = {(r.column, r.rule): r.bad_values for r in validity.impossible_values(df, rules.AUDIT).collect()}
    assert found == {("percentage", "age"): 2, ("percentage", "percent"): 2, ("rate", "percent"): 2, ("month", "month"): 2}


def test_future_dates_follow_the_main_layout(spark):
    df = spark.createDataFrame([("2024-02-01",), ("2024-01-01",), ("01/05/2024",), (None,)], "s string")
    assert validity.future_dates(df, "2024-01-15").first().future_dates == 1


def test_row_shape(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, None, None), (1, 2.0, None), (None, None, None), (1, 1.0, "1")],
                               "a int, b double, c string")
    row = structure.row_shape(df).first()
    assert (row.n_rows, row.empty_rows, row.uniform_rows) == (5, 1, 2)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (1, "a", None, "y"), (None, None, None, "z")], "i int, s string, n int, v string")
    assert sorted(r.column for r in uniqueness.constant_columns(df).collect()) == ["i", "n", "s"]


def test_histogram_of_constant_and_few_values(spark):
    df = spark.createDataFrame([(5.0, 1), (5.0, 2), (5.0, 4), (None, 4)], "c double, v int")
    rows = sorted((r.column, r.bin, r.n) for r in explore.histogram(df, ["c", "v"]).collect())
    assert rows == [("c", 1, 3), ("v", 1, 1), ("v", 2, 1), ("v", 3, 2)]


def test_clean_keeps_the_promises(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 37), float(v) if i % 5 else None, [" A ", "b", "N/A", None, "  "][i % 5], None if i % 10 else "r")
            for i, v in enumerate(rng.normal(0, 1, 200))] + [(3, 1000.0, "b", None), (None,) * 4]
    df = spark.createDataFrame(rows, "`The Id` int, `Val $` double, s string, rare string")
    cleaned = clean.clean(df)
    assert cleaned.columns == ["the_id", "val", "s"]
    assert cleaned.count() <= len(rows) - 1
    assert cleaned.where("the_id is null or val is null or s is null").count() == 0
    assert cleaned.schema["the_id"].dataType.simpleString() == "int"
    assert cleaned.agg(F.max("val")).first()[0] < 100
    assert {r.s for r in cleaned.select("s").distinct().collect()} <= {"a", "b", ""}


@pytest.mark.parametrize("n, kept", [(3, True), (4, False)])
def test_sparse_column_threshold(spark, n, kept):
    df = spark.createDataFrame([(i, None) for i in range(n)], "a int, b int")
    assert ("b" in clean.drop_sparse_columns(df).columns) is kept


def test_all_null_numbers_stay_null_and_text_becomes_unknown(spark):
    df = spark.createDataFrame([(None, None, 1)], "n int, s string, k int")
    row = clean.fill_missing(df).first()
    assert (row.n, row.s) == (None, "unknown")


@pytest.mark.parametrize("rows, schema", [
    ([(1, "a")], "i int, s string"), ([(1,), (2,)], "i int"), ([("x",), ("y",)], "s string"),
    ([(None, 1.0), (None, 2.0)], "n double, v double"), ([(float("nan"), "a", [1]), (1.0, "b", None)], "d double, s string, arr array<int>")])
@pytest.mark.parametrize("profile", ["audit", "universal"])
def test_audit_of_small_tables(spark, rows, schema, profile):
    result = audit(spark.createDataFrame(rows, schema), profile)
    scores = [r.score for r in result.scores.collect()]
    assert len(scores) == 7 and all(0 <= s <= 100 for s in scores)
    assert 0 <= result.summary.first().score <= 100


def test_result_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(numbers(9, 500))
    one = [tuple(r) for r in audit(df.coalesce(1)).scores.orderBy("position").collect()]
    many = [tuple(r) for r in audit(df.repartition(13)).scores.orderBy("position").collect()]
    assert one == many


def test_weights_are_checked():
    assert sum(normalised_weights({d: 2 for d in rules.DIMENSIONS}).values()) == pytest.approx(1)
    for bad in ({}, {**rules.WEIGHTS, "validity": 0}, {**rules.WEIGHTS, "other": 1}):
        with pytest.raises(ValueError):
            normalised_weights(bad)


def test_quick_score_floor_of_the_size_factor(spark):
    assert quick_score(spark.createDataFrame([(1,), (2,)], "a int")).first().size_factor == 0.5


def test_missing_counts_blanks_and_placeholders(spark):
    df = spark.createDataFrame([("N/A",), ("",), ("  ",), (None,), ("ok",)], "s string")
    row = missing.missing_by_column(df, rules.UNIVERSAL).first()
    assert (row.nulls, row.empty_cells, row.whitespace_cells, row.placeholder_cells, row.missing_cells) == (1, 1, 1, 1, 4)

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import rules
from plumbline.functions import text
from plumbline.functions.numeric import pearson, sample_kurtosis, sample_skewness
from plumbline.operators.clean import clean_names
from plumbline.operators.classify import is_id_name
from plumbline.operators.columns import normalise
from plumbline.operators.missing import completeness_score
from plumbline.operators.structure import name_issue


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def results(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_strip_takes_all_white_space(spark):
    values = ["\ta\n", " b ", "c", "  ", "", "\x1cd e　", None, "x" * 100 + " "]
    expected = [v.strip() if v is not None else None for v in values]
    assert results(column(spark, values), text.stripped(F.col("x"))) == expected


def test_number_text(spark):
    values = ["1d", "1.5f", " 2 ", "inf", "nan", "1e5", "0x1A", "1,000", "", "-3.", ".5", "+7", "1_0", "True", "e5", None]
    expected = pd.to_numeric(pd.Series([v for v in values if v is not None]).str.replace("1_0", "x"), errors="coerce").notnull().tolist()
    assert results(column(spark, values), text.is_number_text(text.stripped(F.col("x"))))[:-1] == expected


def test_placeholder_ignores_case_and_padding(spark):
    values = [" N/A ", "Unknown", "blank", "", "#n/a", "not available", "--", "x" * 500]
    stripped = text.stripped(F.col("x"))
    assert results(column(spark, values), text.is_placeholder(stripped)) == [True, True, False, False, True, False, True, False]
    universal = text.is_placeholder(stripped, rules.PLACEHOLDERS_UNIVERSAL)
    assert results(column(spark, values), universal)[5] is True


def test_long_text_key_differs_from_every_short_text(spark):
    long = "a" * 65
    keys = results(column(spark, [long, long + "b", "a" * 64]), text.group_key(F.col("x")))
    assert len(set(keys)) == 3 and keys[2] == "a" * 64 and len(keys[0]) == 65


def test_nan_becomes_null(spark):
    df = normalise(spark.createDataFrame([(float("nan"), 1), (None, 2), (3.0, 3)], "x double, y int"))
    assert df.where("x is null").count() == 2


def test_moments_of_six_values(spark):
    df = column(spark, [1.0, 2.0, 2.0, 3.0, 3.0, 10.0], "double")
    row = df.agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))).first()
    assert row[0] == pytest.approx(2.159963, abs=1e-6) and row[1] == pytest.approx(4.965499, abs=1e-6)


def test_moments_of_few_or_constant_values(spark):
    two = column(spark, [1.0, 2.0], "double").agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))).first()
    same = column(spark, [5.0] * 6, "double").agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))).first()
    assert list(two) == [None, None] and list(same) == [0.0, 0.0]


def test_moments_match_pandas_on_random_data(spark):
    x = np.random.default_rng(1).gamma(2, 3, 500)
    row = column(spark, [float(v) for v in x], "double").agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))).first()
    assert row[0] == pytest.approx(pd.Series(x).skew()) and row[1] == pytest.approx(pd.Series(x).kurt())


def test_pearson_uses_shared_rows_and_is_null_for_a_constant(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0), (4.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    expected = pd.DataFrame(rows, columns=list("abc")).corr()
    row = df.agg(pearson(F.col("a"), F.col("b")), pearson(F.col("a"), F.col("c"))).first()
    assert row[0] == pytest.approx(expected.loc["a", "b"]) and row[1] is None


@pytest.mark.parametrize("rate, score", [(0.0, 100.0), (0.005, 98.0), (0.01, 88.0), (0.05, 72.5), (0.2, 30.0), (0.6, 0.0)])
def test_completeness_tiers(spark, rate, score):
    assert spark.range(1).select(completeness_score(F.lit(rate), rules.AUDIT)).first()[0] == pytest.approx(score)


def test_clean_names_clash_and_empty():
    names = ["Unnamed: 0", " ", "Price ($)", "a  b", "A b", "a_b", "###"]
    assert clean_names(names) == ["unnamed_0", "col_1", "price", "a_b", "a_b_2", "a_b_3", "col_6"]
    assert clean_names(clean_names(names)) == clean_names(names)


def test_name_issues():
    assert [name_issue(n, rules.AUDIT) for n in ("Unnamed: 0", "unnamed", " ", "a  b", "a-b", "ok_1")] == [
        "unnamed", None, "blank", None, "special", None]
    assert [name_issue(n, rules.UNIVERSAL) for n in ("unnamed", " ", "a  b", "a-b")] == ["unnamed", "blank", "spaces", "special"]


def test_id_names():
    assert all(map(is_id_name, ("id", "user_id", "ID_x", " Code ")))
    assert not any(map(is_id_name, ("idea", "c_custkey", "numeric")))

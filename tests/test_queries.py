"""Registered queries against their SQL, at the scale the golden numbers hold for."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from catalog.tables import dirty_customer
from plumbline import audit, before_after, clean
from tests.compare import difference, duck

SF = "/root/testdata/sf0.01"
# A query of each kind; tests/compare.py runs them all.
SHOWN = ("profile_columns", "describe_events", "classify_columns", "histogram", "box_stats_events", "outlier_rows",
         "value_counts_top20", "corr_matrix", "missing_by_column_audit", "consistency_issues_universal",
         "impossible_values_audit", "duplicate_members", "near_duplicates_dirty", "findings", "clean_full", "csv_orders",
         "compare_tables", "custom_rules", "unified_labels", "target_encoding", "tfidf_vocabulary", "rejected_cells", "json_nested", "column_losses_sum")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", SHOWN)
def test_query_equals_sql(spark, connection, name):
    assert difference(queries()[name](spark, SF), connection, oracle_sql()[name]) is None


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 7


def test_golden_scores(spark):
    df = dirty_customer(spark, SF)
    result = audit(df)
    assert [r.score for r in result.scores.orderBy("position").collect()] == [68.33, 83.2, 68.0, 69.92, 56.0, 96.0, 85.0]
    assert (result.summary.first().score, result.summary.first().grade) == (72.75, "B")
    universal = audit(df, "universal", near_rows=False).summary.first()
    assert (universal.score, universal.grade) == (70.27, "Fair")


def test_golden_cleaning(spark):
    df = dirty_customer(spark, SF)
    cleaned = clean(df)
    assert (cleaned.count(), len(cleaned.columns)) == (1500, 14)
    assert cleaned.selectExpr("round(sum(balance_amount), 4)").first()[0] == pytest.approx(7006669.7425)
    score = before_after(df, cleaned).where("metric = 'score'").first()
    assert (score.before, score.after) == (70.1, 72.96)

"""The full quality audit: shared passes, dimension scores, findings and advice.

The passes and what each of them reads:

1. column metrics, all columns, one map-side-combined aggregate per column block
2. labels, the text columns with at most 100 values
3. quartiles and the count beyond the fences, number columns
4. dominant classes, text columns
5. duplicate rows, all columns, the only shuffle of the whole table
6. row-by-row comparison of columns with equal fingerprints, if any
7. correlations, number columns

Each pass ends in a table whose size depends on the number of columns only. Scores and
findings are DataFrame expressions over those.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from plumbline import rules
from plumbline.operators import accuracy, consistency, correlation, duplicates, labels, missing, structure, uniqueness, validity
from plumbline.operators.columns import (
    STRING, Metric, column_metrics, literal_table, merge_metrics, normalise, small_table, table_columns,
)
from plumbline.plans import scores as score_rules
from plumbline.rules import RuleProfile, profile_named

IMPACT_LIMIT = 0.5


@dataclass
class AuditResult:
    """The outcome of an audit; every field but ``profile`` is a DataFrame."""

    profile: RuleProfile
    facts: DataFrame
    scores: DataFrame
    findings: DataFrame
    summary: DataFrame
    actions: DataFrame
    fixes: DataFrame
    details: dict[str, DataFrame]


def audit_metrics(profile: RuleProfile) -> list[Metric]:
    return merge_metrics(
        missing.missing_metrics(profile), uniqueness.CONSTANT_METRICS, duplicates.FINGERPRINT,
        consistency.consistency_metrics(profile), accuracy.SKEW_METRICS, structure.TEXT_NUMBER_METRICS,
        accuracy.DOMINANT_METRICS if profile.name == "universal" else [])


def audit(df: DataFrame, profile: str | RuleProfile = "audit", *, weights: dict[str, float] | None = None,
          as_of: str | None = None, near_rows: bool = True) -> AuditResult:
    """Scores a table in seven dimensions.

    ``as_of`` is the time that dates are compared with (default: now). ``near_rows=False``
    leaves out the search for near-duplicate rows of the universal profile.
    """
    rule = profile_named(profile)
    shares = score_rules.normalised_weights(weights)
    df = normalise(df)
    details = _details(df, rule, as_of, near_rows)
    totals = small_table(_evidence(rule, details).groupBy("kind").agg(
        F.sum("amount").alias("amount"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("columns")))
    facts = _facts(df, rule, totals)
    table = score_rules.score_table(facts, dimension_scores(df, rule), shares)
    findings = _findings(rule, totals, facts)
    return AuditResult(
        profile=rule, facts=facts, scores=table, findings=findings,
        summary=_summary(df, rule, table, facts), actions=action_list(table, findings),
        fixes=_fixes(facts), details=details)


def _details(df: DataFrame, rule: RuleProfile, as_of: str | None, near_rows: bool) -> dict[str, DataFrame]:
    none_near = literal_table(df.sparkSession, [(0, 0, 0.0)], "n_rows bigint, near_rows bigint, near_pct double")
    # These need nothing from each other, so their jobs run side by side. Only strong pairs
    # leave the cluster; all others score nothing.
    apart = {
        "pairs": lambda: small_table(correlation.correlations(df).where(F.abs("r") > rules.CORRELATION_LIMIT)),
        "duplicates": lambda: small_table(duplicates.duplicate_counts(df)),
        "outliers": lambda: small_table(validity.outlier_counts(df)),
        "impossible": lambda: small_table(validity.impossible_values(df, rule)),
    }
    if rule.name == "universal":
        apart |= {
            "future": lambda: small_table(validity.future_dates(df, as_of)),
            "rows": lambda: small_table(structure.row_shape(df)),
            "near": lambda: duplicates.near_duplicates(df) if near_rows else none_near,
        }
    with ThreadPoolExecutor(len(apart)) as pool:
        running = {name: pool.submit(inheritable_thread_target(df.sparkSession)(step)) for name, step in apart.items()}
        stats = small_table(column_metrics(df, audit_metrics(rule)))
        label_table = small_table(labels.label_stats(df, stats))
        identical = duplicates.identical_columns(df, stats)
        done = {name: step.result() for name, step in running.items()}
    pairs = done.pop("pairs")
    found = done | {
        "missing": missing.missing_by_column(df, rule, stats),
        "constant": uniqueness.constant_columns(df, stats, label_table),
        "identical": identical,
        "issues": consistency.consistency_issues(df, rule, stats, label_table),
        "skewed": accuracy.skewed_columns(df, rule, stats),
        "noise": accuracy.noisy_labels(label_table),
        "names": structure.bad_names(df, rule),
        "text_numbers": structure.numbers_as_text(df, stats),
        "pairs": correlation.high_pairs(pairs),
        "redundant": correlation.redundant_columns(pairs),
    }
    if rule.name == "universal":
        found["imbalanced"] = small_table(accuracy.imbalanced_columns(df, stats))
    return found


def _evidence(rule: RuleProfile, details: dict[str, DataFrame]) -> DataFrame:
    """Every count that a score or finding needs, as long rows (kind, name, amount)."""
    def rows(source: str, kind: str, name: Column | None = None, amount: Column | None = None,
             test: Column | None = None) -> DataFrame:
        part = details[source] if test is None else details[source].where(test)
        return part.select(F.lit(kind).alias("kind"), (F.col("column") if name is None else name).alias("name"),
                           (F.lit(1.0) if amount is None else amount).cast("double").alias("amount"))

    def numbers(source: str, *names: str) -> DataFrame:
        part = details[source].select(*[F.col(n).cast("double").alias(n) for n in names])
        return part.unpivot([], list(names), "kind", "amount").select("kind", F.lit("").alias("name"), "amount")

    severity, issue = F.col("severity"), F.col("issue")
    same = F.concat_ws(" = ", "column_a", "column_b")
    alike = F.concat_ws(" ~ ", "column_a", "column_b")
    broken = F.concat(F.col("column"), F.lit(" ("), F.col("rule"), F.lit(": "), F.col("bad_values"), F.lit(")"))
    noisy = F.concat(F.col("column"), F.lit(" ("), F.col("noisy_example"), F.lit(")"))
    high_outliers = F.try_divide(F.col("outliers") * 100.0, F.col("present")) > 5
    # The split into near-identical and high looks at r with four decimals.
    identical_r = F.round("abs_r", 4) > rules.PERFECT_CORRELATION
    parts = [
        numbers("missing", "nulls", "empty_cells", "whitespace_cells", "placeholder_cells", "missing_cells"),
        rows("missing", "cells", amount=F.col("n_rows")),
        rows("missing", "columns_affected", test=F.col("missing_cells") > 0),
        rows("missing", "empty_columns", test=F.col("nulls") == F.col("n_rows")),
        rows("missing", "mostly_null", test=severity == "critical"),
        rows("missing", "partly_null", test=severity == "moderate"),
        numbers("duplicates", "n_rows", "n_distinct_rows", "duplicate_rows"),
        rows("constant", "constant_columns"),
        rows("identical", "identical_pairs", same),
        rows("issues", "mixed_type", test=issue == "mixed_type"),
        rows("issues", "date_format", test=issue == "date_format"),
        rows("issues", "case_columns", test=issue == "case"),
        rows("issues", "encoding", test=issue == "encoding"),
        rows("outliers", "number_cells", amount=F.col("present")),
        rows("outliers", "outlier_cells", amount=F.col("outliers")),
        rows("outliers", "outlier_columns", test=F.col("outliers") > 0),
        rows("outliers", "outliers_high", test=high_outliers),
        rows("outliers", "outliers_low", test=(F.col("outliers") > 0) & ~high_outliers),
        rows("impossible", "rules_hit", broken),
        rows("impossible", "impossible_cells", amount=F.col("bad_values")),
        rows("skewed", "skewed_columns"),
        rows("skewed", "skew_penalty", amount=accuracy.skew_penalty(F.col("skewness"))),
        rows("noise", "noisy_columns", noisy),
        rows("noise", "noisy_labels", amount=F.col("noisy_labels")),
        rows("names", "bad_names"),
        rows("names", "unnamed", test=issue == "unnamed"),
        rows("names", "odd_names", test=issue != "unnamed"),
        rows("text_numbers", "text_numbers"),
        rows("pairs", "high_pairs", alike),
        rows("pairs", "near_identical", alike, test=identical_r),
        rows("pairs", "highly_correlated", alike, test=~identical_r),
        rows("redundant", "redundant_columns"),
    ]
    if rule.name == "universal":
        parts += [rows("imbalanced", "imbalanced_columns"), rows("future", "future_columns"),
                  numbers("rows", "empty_rows", "uniform_rows"), numbers("near", "near_rows", "near_pct")]
    return reduce(DataFrame.unionByName, parts)


WHOLE = ("nulls", "empty_cells", "whitespace_cells", "placeholder_cells", "missing_cells", "cells",
         "columns_affected", "empty_columns", "n_rows", "n_distinct_rows", "duplicate_rows", "constant_columns",
         "identical_pairs", "mixed_type", "date_format", "case_columns", "encoding", "number_cells", "outlier_cells",
         "outlier_columns", "rules_hit", "impossible_cells", "skewed_columns", "noisy_labels", "bad_names",
         "text_numbers", "high_pairs", "redundant_columns")
WHOLE_UNIVERSAL = ("imbalanced_columns", "future_columns", "empty_rows", "uniform_rows", "near_rows")


def _facts(df: DataFrame, rule: RuleProfile, totals: DataFrame) -> DataFrame:
    """One row with every number that a score depends on."""
    amounts = {r.kind: r.amount for r in totals.select("kind", "amount").collect()}
    counts = WHOLE + (WHOLE_UNIVERSAL if rule.name == "universal" else ())
    row = {name: int(amounts.get(name, 0)) for name in counts}
    row["issues"] = sum(row[name] for name in ("mixed_type", "date_format", "case_columns", "encoding"))
    schema = [f"{name} bigint" for name in row]
    shares = {
        "missing_rate": row["missing_cells"] / row["cells"] if row["cells"] else None,
        "rows_per_column": row["n_rows"] / len(df.columns),
        "skew_penalty": amounts.get("skew_penalty", 0.0),
        "near_pct": amounts.get("near_pct", 0.0),
    }
    schema += [f"{name} double" for name in shares]
    return literal_table(df.sparkSession, [(*row.values(), *shares.values())], ", ".join(schema))


def dimension_scores(df: DataFrame, rule: RuleProfile) -> dict[str, Column]:
    n_columns = len(df.columns)
    n_rows = F.col("n_rows").cast("double")
    uniqueness_facts = {
        "duplicate_rate": F.try_divide(F.col("duplicate_rows").cast("double"), n_rows),
        "constant_columns": F.col("constant_columns"), "identical_pairs": F.col("identical_pairs"),
    }
    if rule.name == "universal":
        # The near rate enters with two decimals of a percent.
        uniqueness_facts["near_rate"] = F.round("near_pct", 2) / 100.0
        exact = accuracy.accuracy_score_universal(
            F.col("skew_penalty"), F.col("imbalanced_columns"), len(table_columns(df, STRING)))
    else:
        exact = accuracy.accuracy_score_audit(F.col("skewed_columns"), F.col("noisy_labels"))
    totals = {name: F.col(name) for name in ("outlier_cells", "number_cells", "rules_hit", "impossible_cells")}
    return {
        "completeness": missing.completeness_score(F.col("missing_rate"), rule),
        "uniqueness": uniqueness.uniqueness_score(uniqueness_facts, rule),
        "consistency": consistency.consistency_score(F.col("issues"), n_columns, rule),
        "validity": validity.validity_score(totals, n_rows, rule),
        "accuracy": exact,
        "structure": structure.structure_score(
            F.col("bad_names") + F.col("text_numbers"), F.col("rows_per_column"), n_columns, rule),
        "correlation": correlation.correlation_score(F.col("high_pairs"), rule.correlation_penalty),
    }


def _summary(df: DataFrame, rule: RuleProfile, table: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: profile, raw score, factors, score and grade."""
    raw = table.agg(F.sum("weighted").alias("raw"), F.lit(1).alias("one"))
    joined = raw.join(facts.select("n_rows", F.lit(1).alias("one")), "one")
    if rule.name == "universal":
        diversity = score_rules.diversity_factor(df)
        score = F.round(score_rules.adjusted_score(F.col("raw"), F.col("n_rows"), diversity), 2)
        factors = [score_rules.size_factor(F.col("n_rows")).alias("size_factor"), F.lit(diversity).alias("diversity")]
        grade = score_rules.universal_grade
    else:
        score, grade = F.round("raw", 2), score_rules.audit_grade
        factors = [F.lit(1.0).alias("size_factor"), F.lit(1.0).alias("diversity")]
    return joined.select(F.lit(rule.name).alias("profile"), "n_rows", "raw", *factors,
                         score.alias("score")).withColumn("grade", grade(F.col("score")))


# Findings: (kind of evidence, dimension, rank, severity, text). {n} and {columns} are
# filled in. A kind without evidence gives no finding.
FINDINGS = (
    ("mostly_null", "completeness", 1, "high", "{n} column(s) lack more than 40% of their values: {columns}"),
    ("partly_null", "completeness", 2, "medium", "{n} column(s) lack 5 to 40% of their values: {columns}"),
    ("disguised", "completeness", 3, "medium", "{n} cells hold a disguised null such as 'N/A' or blank text"),
    ("duplicate_rows", "uniqueness", 1, "high", "{n} exact duplicate rows"),
    ("constant_columns", "uniqueness", 2, "medium", "{n} constant column(s): {columns}"),
    ("identical_pairs", "uniqueness", 3, "medium", "{n} identical column pair(s): {columns}"),
    ("near_rows", "uniqueness", 4, "medium", "{n} near-duplicate rows"),
    ("mixed_type", "consistency", 1, "high", "{n} column(s) mix numbers and text: {columns}"),
    ("date_format", "consistency", 2, "medium", "{n} column(s) mix date formats: {columns}"),
    ("case_columns", "consistency", 3, "medium", "{n} column(s) have labels that differ in case only: {columns}"),
    ("encoding", "consistency", 4, "medium", "{n} column(s) show encoding damage: {columns}"),
    ("rules_hit", "validity", 1, "high", "{n} rule(s) broken by impossible values: {columns}"),
    ("outliers_high", "validity", 2, "high", "{n} column(s) with more than 5% extreme outliers: {columns}"),
    ("outliers_low", "validity", 3, "medium", "{n} column(s) with few extreme outliers: {columns}"),
    ("future_columns", "validity", 4, "medium", "{n} column(s) with future dates: {columns}"),
    ("skewed_columns", "accuracy", 1, "medium", "{n} heavily skewed column(s): {columns}"),
    ("noisy_columns", "accuracy", 2, "medium", "possible label noise in {n} column(s): {columns}"),
    ("imbalanced_columns", "accuracy", 3, "medium", "{n} column(s) with one class above 85%: {columns}"),
    ("unnamed", "structure", 1, "high", "{n} unnamed column(s): {columns}"),
    ("odd_names", "structure", 2, "medium", "{n} column name(s) with blanks or special characters: {columns}"),
    ("text_numbers", "structure", 3, "medium", "{n} column(s) keep numbers as text: {columns}"),
    ("few_rows", "structure", 4, "medium", "only {n} rows for the number of columns"),
    ("too_few_rows", "structure", 4, "high", "only {n} rows, fewer than two for each column: results can't be trusted"),
    ("empty_rows", "structure", 5, "medium", "{n} completely empty rows"),
    ("uniform_rows", "structure", 6, "low", "{n} rows hold the same value in every column"),
    ("near_identical", "correlation", 1, "high", "{n} near-identical column pair(s): {columns}"),
    ("highly_correlated", "correlation", 2, "medium", "{n} highly correlated column pair(s): {columns}"),
)
# Label noise belongs to the audit profile alone.
AUDIT_ONLY = ("noisy_columns",)
UNIVERSAL_ONLY = ("too_few_rows",)
FEWEST_ROWS_PER_COLUMN = 2.0


def _findings(rule: RuleProfile, totals: DataFrame, facts: DataFrame) -> DataFrame:
    """(dimension, finding_rank, severity, finding_type, n, columns, message)."""
    foreign = UNIVERSAL_ONLY if rule.name == "audit" else AUDIT_ONLY
    known = [f for f in FINDINGS if f[0] not in foreign]
    texts = literal_table(facts.sparkSession, known,
                          "kind string, dimension string, finding_rank int, severity string, text string")
    none = F.lit("")
    disguised = F.col("placeholder_cells") + F.col("empty_cells") + F.col("whitespace_cells")
    extra = facts.select(F.inline(F.array(
        F.struct(F.lit("disguised").alias("kind"), disguised.cast("double").alias("amount"), none.alias("columns")),
        F.struct(F.lit("few_rows").alias("kind"), F.when(F.col("rows_per_column") < rule.rows_per_column, F.col("n_rows"))
                 .cast("double").alias("amount"), none.alias("columns")),
        F.struct(F.lit("too_few_rows").alias("kind"), F.when(F.col("rows_per_column") < FEWEST_ROWS_PER_COLUMN, F.col("n_rows"))
                 .cast("double").alias("amount"), none.alias("columns")))))
    found = totals.select("kind", "amount", "columns").unionByName(extra).where(F.col("amount") > 0)
    n = F.col("amount").cast("bigint")
    message = F.replace(F.replace(F.col("text"), F.lit("{n}"), n.cast("string")), F.lit("{columns}"), F.col("columns"))
    return found.join(F.broadcast(texts), "kind").select(
        "dimension", "finding_rank", "severity", F.col("kind").alias("finding_type"), n.alias("n"), "columns",
        message.alias("message"))


def action_list(table: DataFrame, findings: DataFrame) -> DataFrame:
    """What to fix first: dimensions by ascending score that cost more than half a point."""
    first = findings.groupBy("dimension").agg(F.min_by("message", "finding_rank").alias("top_issue"))
    impact = F.round((100 - F.col("score")) * F.col("weight"), 1)
    return (table.select("position", "dimension", "score", impact.alias("impact")).where(F.col("impact") > IMPACT_LIMIT)
            .join(first, "dimension").orderBy("score", "position")
            .select("dimension", "score", "impact", "top_issue"))


# (fact, limit, priority, dimension, advice): a fix is due if the fact exceeds the limit.
FIXES = (
    ("missing_pct", 5.0, "HIGH", "completeness", "fill_missing or drop_sparse_columns, or keep a column that marks the gaps"),
    ("duplicate_rows", 0.0, "HIGH", "uniqueness", "drop_duplicate_rows keeps one of each group"),
    ("case_columns", 0.0, "MED", "consistency", "tidy_text makes labels equal that differ in case or padding"),
    ("rules_hit", 0.0, "HIGH", "validity", "impossible_values lists the broken rules; correct them at the source or make them null"),
    ("outlier_columns", 0.0, "MED", "validity", "outlier_rows shows them; cap_outliers moves them to the fence"),
    ("text_numbers", 0.0, "MED", "structure", "Cast the columns that numbers_as_text lists"),
    ("redundant_columns", 0.0, "LOW", "correlation", "Keep one of each pair that high_pairs calls perfect"),
    ("skewed_columns", 0.0, "LOW", "accuracy", "Take a logarithm or ranks of the columns that skewed_columns lists"),
)


def _fixes(facts: DataFrame) -> DataFrame:
    """Recommended fixes in fixed order: fix_rank, priority, dimension, amount, advice."""
    facts = facts.withColumn("missing_pct", F.round(F.col("missing_rate") * 100, 4))
    rows = [F.struct(F.lit(i).alias("fix_rank"), F.lit(priority).alias("priority"), F.lit(dimension).alias("dimension"),
                     F.col(fact).cast("double").alias("amount"), F.lit(limit).alias("limit"), F.lit(advice).alias("advice"))
            for i, (fact, limit, priority, dimension, advice) in enumerate(FIXES, 1)]
    return facts.select(F.inline(F.array(*rows))).where(F.col("amount") > F.col("limit")).drop("limit")


def score_report(result: AuditResult) -> DataFrame:
    """The report: weight, score, contribution and status per dimension, and the final row."""
    weight, weighted = F.round("weight", 3), F.round("weighted", 2)
    rows = result.scores.select("position", "dimension", weight.alias("weight"), "score", weighted.alias("weighted"),
                                score_rules.universal_grade(F.col("score")).alias("status"))
    final = result.summary.select(
        F.lit(len(rules.DIMENSIONS) + 1).alias("position"), F.lit("final score").alias("dimension"),
        F.lit(None).cast("double").alias("weight"), "score", F.lit(None).cast("double").alias("weighted"),
        score_rules.universal_grade(F.col("score")).alias("status"))
    return rows.unionByName(final)


def worst_columns(result: AuditResult, n: int = 20) -> DataFrame:
    """The n columns with the highest missing share."""
    return (result.details["missing"].where(F.col("missing_cells") > 0)
            .orderBy(F.desc("missing_pct"), "position").limit(n))


def worst_outliers(result: AuditResult, n: int = 6) -> DataFrame:
    """The n columns with the highest outlier share."""
    return validity.outlier_columns(result.details["outliers"]).orderBy(F.desc("outlier_pct"), "column").limit(n)

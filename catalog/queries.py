"""Every registered query: name -> function of (spark, sf_dir). All run on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from catalog.tables import dirty_customer, table
from plumbline import rules
from plumbline.operators import (
    accuracy, classify, clean, consistency, correlation, duplicates, explore, frequencies, labels, missing, profile,
    structure, uniqueness, validity,
)
from plumbline.operators.columns import column_ref, literal_table, normalise, table_columns
from plumbline.plans import audit as audit_plan, scores
from plumbline.plans.compare import before_after
from plumbline.sources.staging import staged_path
from plumbline.sources.tables import export_csv, read_csv, read_table, write_csv, write_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
# A time inside the range of the event table, so that some events are later.
AS_OF = "2024-01-20 00:00:00"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles with a fixed number of decimals, since sums depend on their order."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.round(column_ref(n), digits) for n in doubles}) if doubles else df


def query(*sources: str, name: str | None = None, digits: int = DIGITS):
    """Registers a function of the source tables as a query."""
    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(function(*[_load(spark, sf_dir, s) for s in sources]), digits)
        QUERIES[name or function.__name__] = run
        return function
    return register


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return normalise(dirty_customer(spark, sf_dir) if name == "dirty_customer" else table(spark, sf_dir, name))


def _numbers(df: DataFrame) -> list[str]:
    """All number columns, ids and codes included."""
    return [c.name for c in table_columns(df, "number")]


# ------------------------------------------------------------------- profile

query("dirty_customer", name="table_shape")(profile.table_shape)
query("dirty_customer", name="null_cells")(profile.null_cells)
query("dirty_customer", name="duplicate_rows")(duplicates.duplicate_counts)
query("lineitem", name="duplicate_rows_lineitem")(duplicates.duplicate_counts)


@query("documents")
def duplicate_texts(df):
    return duplicates.duplicate_counts(df.drop("doc_id"))


@query("documents")
def size_estimate(df):
    return profile.size_estimate(df).drop("position")


@query("customer")
def first_rows(df):
    return profile.first_rows(df, ["c_custkey"])


@query("customer")
def last_rows(df):
    return profile.last_rows(df, ["c_custkey"])


def _details(order_by):
    return lambda df: profile.column_details(df, order_by).select(
        "column", "dtype", "non_null", "null_pct", "n_distinct", "sample")


query("dirty_customer", name="profile_columns")(_details("cust_id"))
query("orders", name="profile_columns_orders")(_details("o_orderkey"))
query("lineitem", name="profile_columns_lineitem")(
    lambda df: profile.column_details(df).select("column", "dtype", "non_null", "null_pct", "n_distinct"))
query("embeddings", name="profile_columns_embeddings")(
    lambda df: profile.column_details(df).select("column", "dtype", "non_null", "null_pct", "n_distinct"))
query("customer", name="describe_all")(lambda df: profile.describe(df).drop("position"))
query("events", name="describe_events")(lambda df: profile.describe(df).drop("position"))

# ---------------------------------------------------------------- classifier

ROLE_COLUMNS = ["column", "tag", "label", "null_pct", "n_distinct", "sample"]
query("dirty_customer", name="classify_columns")(
    lambda df: classify.classify_columns(df, "cust_id").select(*ROLE_COLUMNS))
query("lineitem", name="classify_lineitem")(
    lambda df: classify.classify_columns(df).select("column", "tag", "label", "null_pct", "n_distinct"))
query("documents", name="classify_documents")(
    lambda df: classify.classify_columns(df).select("column", "tag", "label", "null_pct", "n_distinct"))
query("events", name="classify_events")(
    lambda df: classify.classify_columns(df).select("column", "tag", "label", "null_pct", "n_distinct"))
query("dirty_customer", name="date_parse_share")(classify.date_parse_share)
query("dirty_customer", name="column_warnings")(lambda df: classify.column_warnings(classify.classify_columns(df)))
query("dirty_customer", name="encoding_advice")(lambda df: classify.encoding_advice(classify.classify_columns(df)))
query("dirty_customer", name="valid_targets")(lambda df: classify.valid_targets(classify.classify_columns(df)))


@query("customer")
def column_header(df):
    return (classify.classify_columns(df).where(F.col("column") == "c_mktsegment")
            .select("column", "tag", "null_pct", "n_distinct", "n_rows"))


# ------------------------------------------------------------------ explorer

@query("events")
def histogram_infinite(df):
    """Infinite values are counted beside the finite ones."""
    value = F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).when(F.col("event_id") % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return explore.histogram(df.select(value.alias("value"), F.lit(float("inf")).alias("only")), ["value", "only"])


query("events", name="histogram")(lambda df: explore.histogram(df, ["value", "user_id"]))
query("dirty_customer", name="histogram_dirty")(lambda df: explore.histogram(df, ["birth_month", "age", "bal_a"]))
query("lineitem", name="numeric_summary", digits=5)(lambda df: explore.numeric_summary(df, _numbers(df)))
query("lineitem", name="numeric_summary_by_role", digits=5)(explore.numeric_summary)
query("events", name="numeric_details")(lambda df: explore.numeric_details(df, ["value"]))
query("documents", name="numeric_details_documents")(lambda df: explore.numeric_details(df, ["n_chars"]))
query("lineitem", name="box_stats")(lambda df: explore.box_stats(df, _numbers(df)))
query("events", name="box_stats_events")(lambda df: explore.box_stats(df, ["value"]))
query("events", name="outlier_rows")(lambda df: explore.outlier_rows(df, "value", ["event_id"]))
query("documents", name="outlier_rows_all")(
    lambda df: explore.outlier_rows(df, "n_chars", ["doc_id"], limit=None).select("doc_id", "lang", "source", "n_chars"))
query("events", name="outlier_summary")(lambda df: explore.outlier_summary(df, "value"))
query("dirty_customer", name="value_counts_top20")(
    lambda df: explore.category_values(df, ["segment", "segment_case", "label", "nation_text", "mixed_code"]))
query("dirty_customer", name="value_counts_texts")(
    lambda df: explore.category_values(df, [c.name for c in table_columns(df, "string")]))
query("events", name="value_counts_top30")(lambda df: explore.category_values(df, ["event_type", "props"], 30))
query("dirty_customer", name="category_summary")(
    lambda df: explore.category_summary(df, [c.name for c in table_columns(df, "string")]))
query("dirty_customer", name="column_modes")(
    lambda df: frequencies.modes(df, table_columns(df, "string")))
query("lineitem", name="corr_matrix")(lambda df: correlation.correlation_matrix(df, table_columns(df, "number")))
query("lineitem", name="box_stats_by_role")(explore.box_stats)


@query("dirty_customer")
def corr_by_role(df):
    """Numbers and two-valued columns, a boolean among them."""
    df = df.select("cust_id", "balance_amount", "age", "bal_a", "bal_b", (F.col("age") > 40).alias("older"))
    return correlation.correlation_matrix(df)


query("lineitem", name="pair_correlation")(
    lambda df: explore.pair_correlation(df, "l_quantity", "l_extendedprice"))
query("lineitem", name="ols_trend")(lambda df: explore.ols_trend(df, "l_quantity", "l_extendedprice"))
query("labels", name="class_balance")(lambda df: explore.class_balance(df, "quality"))
query("orders", name="class_balance_orders")(lambda df: explore.class_balance(df, "o_orderpriority"))
query("orders", name="class_counts")(lambda df: explore.class_counts(df, "o_orderstatus"))
query("documents", name="regression_target")(lambda df: explore.regression_target(df, "n_chars"))
query("dirty_customer", name="distinct_sample")(lambda df: explore.distinct_sample(df, "mixed_code", "cust_id"))

# ----------------------------------------------------------------- detectors



def _register_for(rule: rules.RuleProfile) -> None:
    """The detectors that differ between the rule profiles."""
    def add(source: str, name: str, function) -> None:
        query(source, name=f"{name}_{rule.name}")(lambda df: function(df, rule))

    def missing_columns(df, profile):
        return missing.missing_by_column(df, profile).drop("position")

    def impossible_lineitem(df, profile):
        return validity.impossible_values(df.select(
            (F.col("l_discount") * 2000 - 10).alias("discount_rate"), (F.col("l_tax") - 0.01).alias("tax_amount"),
            (F.col("l_linenumber") * 2 - 1).alias("ship_month"), "l_quantity"), profile)

    add("dirty_customer", "missing_by_column", missing_columns)
    add("documents", "missing_by_column_documents", missing_columns)
    add("dirty_customer", "case_issues", consistency.case_issues)
    add("dirty_customer", "date_format_mix", consistency.date_format_mix)
    add("documents", "date_format_mix_documents", consistency.date_format_mix)
    add("dirty_customer", "garbled_text", consistency.garbled_text)
    add("documents", "garbled_text_documents", consistency.garbled_text)
    add("dirty_customer", "consistency_issues", consistency.consistency_issues)
    add("dirty_customer", "impossible_values", validity.impossible_values)
    add("lineitem", "impossible_values_lineitem", impossible_lineitem)
    add("dirty_customer", "skewed_columns", accuracy.skewed_columns)
    add("labels", "skewed_columns_labels", accuracy.skewed_columns)


_register_for(rules.AUDIT)
_register_for(rules.UNIVERSAL)

query("dirty_customer", name="missing_totals")(
    lambda df: missing.missing_totals(missing.missing_by_column(df, rules.UNIVERSAL)))
query("dirty_customer", name="constant_columns")(lambda df: uniqueness.constant_columns(df).drop("position"))
query("dirty_customer", name="identical_columns")(duplicates.identical_columns)
query("dirty_customer", name="duplicate_members")(lambda df: duplicates.duplicate_members(df, ["cust_id"]))
query("part", name="near_duplicates")(lambda df: duplicates.near_duplicates(df, ["p_size", "p_retailprice"]))
query("dirty_customer", name="near_duplicates_dirty")(duplicates.near_duplicates)
query("dirty_customer", name="mixed_types")(consistency.mixed_types)
query("documents", name="mixed_types_documents")(consistency.mixed_types)
query("dirty_customer", name="label_stats")(labels.label_stats)


@query("dirty_customer")
def label_noise(df):
    return accuracy.noisy_labels(labels.label_stats(df))


query("dirty_customer", name="outlier_columns")(lambda df: validity.outlier_columns(validity.outlier_counts(df)))
query("events", name="outlier_columns_events")(lambda df: validity.outlier_columns(validity.outlier_counts(df)))
query("dirty_customer", name="worst_outliers")(
    lambda df: audit_plan.worst_outliers(audit_plan.audit(df)))
query("events", name="future_dates")(lambda df: validity.future_dates(df, AS_OF))
query("dirty_customer", name="future_dates_text")(lambda df: validity.future_dates(df, AS_OF))


@query("orders")
def imbalance(df):
    rare = F.when(F.col("o_totalprice") > 400000, "high").when(F.col("o_totalprice") < 2000, "low").otherwise("usual")
    return accuracy.imbalanced_columns(df.select("o_orderstatus", "o_orderpriority", rare.alias("price_class")))


query("dirty_customer", name="numbers_as_text")(structure.numbers_as_text)
query("dirty_customer", name="row_shape")(structure.row_shape)
query("nation", name="row_shape_nation")(lambda df: structure.row_shape(df.select(
    F.col("n_nationkey").cast("double").alias("a"), F.col("n_regionkey").alias("b"))))
query("dirty_customer", name="corr_pairs")(lambda df: correlation.high_pairs(correlation.correlations(df)))
query("dirty_customer", name="redundant_columns")(
    lambda df: correlation.redundant_columns(correlation.correlations(df)))

ODD_NAMES = ["Unnamed: 0", " ", "Price ($)", "a  b", "c_mktsegment"]


def _odd_names(rule):
    """The name issues of a table with odd names, each with the cells it affects."""
    def run(df):
        odd = df.toDF(*ODD_NAMES)
        issues = structure.bad_names(odd, rule)
        cells = missing.missing_by_column(odd, rule).select("column", (F.col("n_rows") - F.col("nulls")).alias("cells"))
        return issues.join(cells, "column")
    return run


query("customer", name="bad_names_audit")(_odd_names(rules.AUDIT))
query("customer", name="bad_names_universal")(_odd_names(rules.UNIVERSAL))

# -------------------------------------------------------------------- scores

SCORE_COLUMNS = ["dimension", "weight", "score", "weighted"]
query("dirty_customer", name="dqs_audit")(lambda df: audit_plan.audit(df, "audit").scores.select(*SCORE_COLUMNS, "band"))
query("dirty_customer", name="dqs_audit_summary")(
    lambda df: audit_plan.audit(df, "audit").summary.select("profile", "n_rows", "score", "grade"))
query("dirty_customer", name="dqs_universal")(
    lambda df: audit_plan.audit(df, "universal", as_of=AS_OF).scores.select(*SCORE_COLUMNS))
query("dirty_customer", name="dqs_universal_summary")(
    lambda df: audit_plan.audit(df, "universal", as_of=AS_OF).summary)
query("lineitem", name="dqs_audit_lineitem")(lambda df: audit_plan.audit(df, "audit").scores.select(*SCORE_COLUMNS))
query("dirty_customer", name="dqs_quick")(scores.quick_score)
query("dirty_customer", name="user_weights")(lambda df: audit_plan.audit(
    df, "audit", weights={**rules.WEIGHTS, "completeness": 0.5, "validity": 0.4}).scores.select(*SCORE_COLUMNS))
query("dirty_customer", name="action_list")(lambda df: audit_plan.audit(df, "audit").actions.drop("top_issue"))
query("dirty_customer", name="findings")(
    lambda df: audit_plan.audit(df, "audit").findings.select("dimension", "finding_rank", "severity", "finding_type", "n"))
query("dirty_customer", name="fixes")(lambda df: audit_plan.audit(df, "universal", as_of=AS_OF).fixes)
query("dirty_customer", name="score_report")(
    lambda df: audit_plan.score_report(audit_plan.audit(df, "universal", as_of=AS_OF)).drop("position"))
query("dirty_customer", name="worst_columns")(
    lambda df: missing.missing_by_column(df, rules.UNIVERSAL).where("missing_cells > 0")
    .orderBy(F.desc("missing_pct"), "position").limit(20).select("column", "missing_pct"))

# ------------------------------------------------------------------ cleaning

query("customer", name="clean_names")(lambda df: clean.rename_columns(df.toDF(*ODD_NAMES)))
query("dirty_customer", name="drop_empty_rows")(clean.drop_empty_rows)
query("dirty_customer", name="null_placeholders")(clean.null_placeholders)
query("dirty_customer", name="drop_sparse_columns")(clean.drop_sparse_columns)
query("dirty_customer", name="fill_missing")(
    lambda df: clean.fill_missing(clean.null_placeholders(df)))
query("dirty_customer", name="drop_duplicate_rows")(clean.drop_duplicate_rows)
query("dirty_customer", name="tidy_text")(clean.tidy_text)
query("events", name="cap_outliers")(clean.cap_outliers)
query("dirty_customer", name="clean_full")(clean.clean)
query("events", name="clean_events")(clean.clean)
query("dirty_customer", name="before_after")(lambda df: before_after(df, clean.clean(df)))
query("dirty_customer", name="clean_preview")(lambda df: clean.preview(clean.clean(df), ["cust_id"]))

# ------------------------------------------------------------------- sources


@query("orders")
def csv_orders(df):
    """Orders written as CSV and read back with inferred types."""
    path = staged_path(df.sparkSession, "orders.csv")
    write_csv(df, path)
    return read_csv(df.sparkSession, path)


@query("dirty_customer")
def csv_dirty_customer(df):
    """Null tokens become null on reading; blank text stays."""
    path = staged_path(df.sparkSession, "dirty.csv")
    write_csv(df, path)
    return read_csv(df.sparkSession, path)


def _through_csv(df: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    path = staged_path(df.sparkSession, "table.csv")
    df.write.option("header", True).option("escape", '"').option("encoding", encoding).csv(path)
    return read_csv(df.sparkSession, path)


@query("documents")
def csv_documents(df):
    """Texts with line breaks, quotes and commas."""
    return _through_csv(df)


@query("documents")
def csv_latin1(df):
    """A file in another encoding than UTF-8; a character that it lacks is written as a question mark."""
    return _through_csv(df.select("doc_id", F.regexp_replace("text", r"[^\x00-\xFF]", "?").alias("text")), "ISO-8859-1")


@query("customer")
def csv_replacement_character(df):
    """Valid UTF-8 stays UTF-8, whatever characters it holds."""
    return _through_csv(df.select("c_custkey", F.concat(F.lit("caf\u00e9 \ufffd "), "c_name").alias("c_name")))


@query("supplier", "region")
def rejected_files(supplier, region):
    """Files that hold no table, and what reading them says; beside them one that can be read."""
    spark = supplier.sparkSession
    paths = {name: staged_path(spark, f"{name}.csv") for name in ("rows beyond the header", "no rows", "blank", "good")}
    supplier.select(F.when(F.col("s_suppkey") == 1, "a,b").otherwise(F.concat_ws(",", "s_suppkey", "s_nationkey", "s_name")).alias("value")).coalesce(1).orderBy(
        F.col("value") != "a,b").write.text(paths["rows beyond the header"])
    supplier.where("false").coalesce(1).write.option("header", True).csv(paths["no rows"])
    region.select(F.lit("").alias("value")).coalesce(1).write.text(paths["blank"])
    write_csv(region, paths["good"])
    found = []
    for name, path in paths.items():
        try:
            found.append((name, "read", read_table(spark, path).count()))
        except ValueError as error:
            found.append((name, str(error), 0))
    return literal_table(spark, found, "file string, outcome string, n bigint")


@query("supplier")
def csv_export(df):
    """The cleaned copy beside the original name."""
    folder = staged_path(df.sparkSession, "export")
    return read_csv(df.sparkSession, export_csv(df, folder, "supplier.csv"))


@query("dirty_customer", digits=4)
def report_csv(df):
    """The score report, written and read back."""
    path = staged_path(df.sparkSession, "report.csv")
    write_report(audit_plan.score_report(audit_plan.audit(df, "universal", as_of=AS_OF)), path)
    return read_csv(df.sparkSession, path)


@query("orders")
def clean_nested(df):
    """Rows that differ in a map only are no duplicates."""
    keyed = df.select((F.col("o_orderkey") % 100).alias("k"), F.create_map("o_orderstatus", "o_orderpriority").alias("m"))
    return clean.clean(keyed).select("k", F.map_keys("m")[0].alias("status"), F.map_values("m")[0].alias("priority"))


def _with_nan(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))


query("events", name="describe_nan")(lambda df: profile.describe(_with_nan(df)).select(
    "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))
query("events", name="classify_nan")(lambda df: classify.classify_columns(_with_nan(df)).select(
    "column", "tag", "null_pct", "n_distinct"))

# One time in the layouts that date texts come in.
LAYOUTS = {
    "zoned": "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z')",
    "shifted": "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00')",
    "minutes": "date_format(ts, 'yyyy-MM-dd HH:mm')",
    "fraction": "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '.25')",
    "written": "date_format(ts, 'd MMM yyyy HH:mm')",
    "unpadded": "date_format(ts, 'M/d/yyyy')",
    "compact": "date_format(ts, 'yyyyMMdd')",
    "month": "date_format(ts, 'MMM yyyy')",
    "clock": "date_format(ts, 'M/d/yyyy h:mm a')",
}


def _layouts(df: DataFrame) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in LAYOUTS.items()])


query("events", name="date_layouts")(lambda df: classify.date_parse_share(_layouts(df)))
query("events", name="future_dates_layouts")(lambda df: validity.future_dates(_layouts(df), AS_OF))

from catalog import features  # noqa: E402, F401  (registers its queries)

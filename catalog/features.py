"""Queries over several tables, rules, labels, encodings and sources; registered with those of ``catalog.queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.queries import query
from plumbline.operators import checks, convert, encoding, summaries, tfidf, unify
from plumbline.operators.checks import Dependency, Reference, RowRule
from plumbline.sources.staging import staged, staged_path
from plumbline.plans import attribution, audit as audit_plan
from plumbline.sources.nested import read_json
from plumbline.sources.tables import read_sources

# ------------------------------------------------------------ several tables


def _changed_orders(df: DataFrame) -> DataFrame:
    """Orders of a later delivery: dearer, some without a date, one status more, a column less, one more and one in another kind."""
    return df.where("o_orderkey % 3 = 0").selectExpr(
        "CAST(o_orderkey AS INT) AS o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 1.5 END AS o_totalprice",
        "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS o_orderdate", "CAST(o_orderkey % 7 AS INT) AS o_orderpriority", "o_orderkey % 2 = 0 AS is_even")


@query("orders")
def compare_tables(df):
    """Schema differences and drift of a second table, from summaries alone; that of the second is merged from two parts."""
    changed = _changed_orders(df)
    parts = [summaries.summarise(changed.where(f"o_orderkey % 2 = {n}"), "changed") for n in (0, 1)]
    return summaries.compare(staged(summaries.merged(summaries.summarise(df, "base"), *parts), "summary"), "base")


@query("events")
def compare_sources(df):
    """The kinds of event as sources of one table, each against the clicks."""
    return summaries.compare(staged(summaries.summarise(df, F.col("`event_type`")), "summary"), "click")


@query("orders")
def read_several_files(df):
    """Two files with different columns read as one table that names each row's source."""
    spark = df.sparkSession
    first, second = staged_path(spark, "first.parquet"), staged_path(spark, "second.parquet")
    df.write.parquet(first)
    _changed_orders(df).select("o_orderkey", "o_orderstatus", "is_even").write.parquet(second)
    both = read_sources(spark, {"first": first, "second": second})
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("o_custkey").alias("customers"), F.count("is_even").alias("evens"),
                                      F.sum("o_orderkey").alias("keys"))


# --------------------------------------------------------------------- rules

ORDER_RULES = [
    RowRule("positive price", "o_totalprice > 0", fix=checks.DROP),
    RowRule("known status", "o_orderstatus IN ('F', 'O')", fix=(("o_orderstatus", "'?'"),)),
    RowRule("dear orders are urgent", "o_totalprice < 300000 OR o_orderpriority IN ('1-URGENT', '2-HIGH')", checks.WARNING, (("o_totalprice", "300000"),)),
    RowRule("key or customer", "o_orderkey % 1000 <> 0 OR o_custkey > 100"),
    RowRule("dated", "o_orderdate >= TIMESTAMP_NTZ '1993-01-01 00:00:00'"),
]


@query("orders", "customer")
def custom_rules(orders, customer):
    """Conditions, references and dependencies in one report."""
    rules = [*ORDER_RULES, Reference("known customer", ("o_custkey",), "customers", ("c_custkey",)),
             Reference("customer in a low nation", ("o_custkey",), "low", ("c_custkey",)),
             Dependency("customer decides priority", ("o_custkey",), "o_orderpriority"),
             Dependency("key decides all", ("o_orderkey",), "o_totalprice")]
    return checks.check_rules(orders, rules, {"customers": customer, "low": customer.where("c_nationkey < 12")})


query("orders", name="rule_broken_rows")(lambda df: checks.broken_rows(df, ORDER_RULES).withColumn("broken_rules", F.concat_ws("; ", "broken_rules")))
query("orders", name="rule_fixes")(lambda df: checks.apply_fixes(df, ORDER_RULES))


@query("lineitem", "part")
def broken_references(lineitem, part):
    rule = Reference("listed part", ("l_partkey",), "part", ("p_partkey",))
    return checks.broken_references(lineitem, rule, part.where("p_partkey % 10 <> 0"))


DEPENDENCY = Dependency("flag of a day", ("l_shipdate", "l_linenumber"), "l_returnflag")
query("lineitem", name="dependencies")(lambda df: checks.broken_dependencies(df, DEPENDENCY))
query("lineitem", name="dependency_rows")(lambda df: checks.broken_dependency_rows(df, DEPENDENCY))

# -------------------------------------------------------------------- labels

MISSPELT = """CASE WHEN c_custkey % 13 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 17 = 0 THEN concat(' ', c_mktsegment)
  WHEN c_custkey % 19 = 0 THEN concat(substring(c_mktsegment, 1, 3), substring(c_mktsegment, 5, 20))
  WHEN c_custkey % 23 = 0 THEN concat(substring(c_mktsegment, 1, 4), 'x', substring(c_mktsegment, 5, 20))
  WHEN c_custkey % 29 = 0 THEN concat(substring(c_mktsegment, 1, 2), '_', substring(c_mktsegment, 4, 20)) ELSE c_mktsegment END AS segment"""


def _misspelt(df: DataFrame) -> DataFrame:
    return df.selectExpr("c_custkey", MISSPELT, "c_name")


query("customer", name="label_spellings")(lambda df: unify.label_map(_misspelt(df)))
query("customer", name="unified_labels")(lambda df: unify.unify_labels(_misspelt(df), ["segment"]))

# ----------------------------------------------------------------- encodings


@query("orders")
def target_encoding(df):
    """Order value by priority, each row from the folds it isn't in."""
    return encoding.target_encoding(df, "o_orderpriority", "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_orderpriority_target")


def _fitted(df: DataFrame) -> DataFrame:
    return df.where("c_nationkey < 12").withColumnRenamed("c_mktsegment", "segment")


@query("customer")
def scaled(df):
    """Fitted on some nations, stored, and applied to all."""
    parameters = [encoding.fit_scaling(_fitted(df), ["c_acctbal", "c_nationkey"], m) for m in (encoding.STANDARD, encoding.SPAN, encoding.ROBUST)]
    stored = staged(parameters[0].unionByName(parameters[1]).unionByName(parameters[2]), "fitted")
    return encoding.apply_encodings(df, stored).drop("c_name", "c_mktsegment")


@query("customer")
def one_hot(df):
    """Three segments by name, the rest as other: misspelt labels weren't in the fitted table."""
    stored = staged(encoding.fit_one_hot(_fitted(df), ["segment"], 3), "fitted")
    return encoding.apply_encodings(_misspelt(df), stored).drop("segment", "c_name")


@query("customer")
def frequency_encoded(df):
    stored = staged(encoding.fit_frequencies(_fitted(df), ["segment"]), "fitted")
    return encoding.apply_encodings(_misspelt(df), stored).drop("c_name")


@query("customer")
def target_fitted(df):
    """Target means fitted on some nations for the labels of all, unseen ones included."""
    stored = staged(encoding.fit_target(_fitted(df), ["segment"], "c_acctbal"), "fitted")
    return encoding.apply_encodings(_misspelt(df), stored).drop("c_name")


@query("documents")
def tfidf_documents(df):
    """The vectors of whole texts, one row per index and weight."""
    vectors, _ = tfidf.tfidf(df, "doc_id", "text")
    return vectors.select("doc_id", F.explode(F.arrays_zip("indices", "weights")).alias("x")).select("doc_id", F.col("x.indices").alias("index"), F.col("x.weights").alias("weight"))


@query("documents")
def tfidf_vocabulary(df):
    return tfidf.vocabulary(staged(tfidf.term_counts(df, "doc_id", "text"), "counts"))


# ---------------------------------------------------------------- conversion

TEXTS = """SELECT c_custkey, c_name, CASE c_custkey % 7 WHEN 0 THEN '1,234.50' WHEN 1 THEN concat(' ', CAST(c_custkey AS STRING), ' ') WHEN 2 THEN '12.0'
    WHEN 3 THEN '99999999999999999999' WHEN 4 THEN 'about 5' WHEN 5 THEN '' ELSE '3.25' END AS amount,
  CASE c_custkey % 9 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' WHEN 2 THEN '31/12/2020' WHEN 3 THEN '20240120' WHEN 4 THEN 'Jan 2024' WHEN 5 THEN '7 Mar 2021'
    WHEN 6 THEN '05/06/2022 03:15 PM' WHEN 7 THEN 'soon' END AS day,
  CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' END AS flag FROM {customer}"""


def _conversion(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = df.sparkSession.sql(TEXTS, customer=df)
    return convert.convert(texts.withColumn("whole", F.col("amount")), {"amount": "double", "whole": "bigint", "day": "timestamp", "flag": "boolean"}, "c_custkey")


query("customer", name="converted")(lambda df: _conversion(df)[0].withColumn("day", F.col("day").cast("timestamp_ntz")))
query("customer", name="rejected_cells")(lambda df: _conversion(df)[1])
query("dirty_customer", name="suggested_types")(convert.suggested_types)


@query("documents")
def repaired_text(df):
    """Double encoding, decomposed letters and odd blanks planted in every third text and repaired again."""
    damaged = df.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
                        .when(F.col("doc_id") % 3 == 1, F.regexp_replace(F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")), " ", "  \t")).otherwise(F.col("text")).alias("text"))
    return convert.repair_text(damaged)


# ---------------------------------------------------------------------- JSON


def _json_lines(df: DataFrame):
    """Events as JSON lines with an object, an array of objects and an array of numbers; every fiftieth is cut short."""
    line = F.to_json(F.struct("event_id", "event_type", F.from_json("props", "k INT").alias("props"), F.struct(F.col("value").alias("amount"), F.struct(
        F.col("user_id").alias("id")).alias("user")).alias("detail"), F.expr("transform(sequence(1, event_id % 3 + 1), x -> struct(x AS rank, "
        "transform(sequence(1, x), y -> y * event_id) AS hits))").alias("steps")))
    path = staged_path(df.sparkSession, "events.json")
    df.select(F.when(F.col("event_id") % 50 == 7, F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(path)
    return read_json(df.sparkSession, path)


@query("events")
def json_events(df):
    """The records as a flat table."""
    return _json_lines(df).rows.drop("record")


@query("events")
def json_nested(df):
    """The arrays in the arrays, under the events they belong to."""
    tables = _json_lines(df)
    keys = tables.rows.select("record", "event_id")
    steps = tables.sides["steps"].select("record", "position", "rank")
    return tables.sides["steps.hits"].join(steps, ["record", "position"]).join(keys, "record").drop("record")


query("events", name="json_report")(lambda df: _json_lines(df).report())
query("events", name="json_bad_lines")(lambda df: _json_lines(df).bad.select("line"))

# --------------------------------------------------------------- attribution


@query("dirty_customer")
def column_losses(df):
    """What each column costs each dimension of the audit."""
    return attribution.column_losses(df, audit_plan.audit(df, "audit"))


@query("dirty_customer")
def column_scores(df):
    return attribution.column_scores(df, audit_plan.audit(df, "audit"))


@query("dirty_customer")
def column_losses_sum(df):
    """The parts of each dimension add up to what its score lacks of 100."""
    result = audit_plan.audit(df, "audit")
    losses = attribution.column_losses(df, result).groupBy("dimension").agg(F.sum("loss").alias("loss"), F.sum("points").alias("points"))
    return result.scores.select("dimension", "score").join(losses, "dimension", "left")

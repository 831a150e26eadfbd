"""Column roles: id, constant, datetime, numeric, binary, categorical, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import rules
from plumbline.functions.text import parsed_date
from plumbline.operators.columns import (
    ALL_KINDS, BOOLEAN, DATETIME, NUMBER, STRING, Metric, column_metrics, literal_table, normalise, table_columns,
)
from plumbline.operators.frequencies import distinct_counts
from plumbline.operators.profile import NULL_METRICS, sample_values

ROLE_SCHEMA = "column string, id_name boolean"


def is_id_name(name: str) -> bool:
    """The name is a key word or begins or ends with one, set off by an underscore."""
    parts = name.lower().strip()
    return any(parts == word or parts.startswith(word + "_") or parts.endswith("_" + word)
               for word in rules.ID_KEYWORDS)


def _layout_count(layout: str, shape: str):
    return lambda c: F.count(parsed_date(c, layout, shape))


DATE_LAYOUT_METRICS = [Metric(f"layout_{i}", "bigint", (STRING,), _layout_count(*f), "short")
                       for i, f in enumerate(rules.DATE_FORMATS)]


def date_parse_share(df: DataFrame) -> DataFrame:
    """(column, date_share): the part of a text column's cells that one date layout reads."""
    stats = column_metrics(df, [*NULL_METRICS, *DATE_LAYOUT_METRICS], table_columns(df, STRING))
    return stats.select("column", _date_share().alias("date_share"))


def _date_share() -> Column:
    best = F.greatest(*[F.col(m.name) for m in DATE_LAYOUT_METRICS])
    return F.try_divide(best.cast("double"), F.col("n_rows") - F.col("nulls"))


def _role() -> Column:
    distinct, share = F.col("n_distinct"), F.try_divide(F.col("n_distinct").cast("double"), F.col("n_rows"))
    text = F.col("kind") == STRING
    number = F.col("kind").isin(NUMBER, BOOLEAN)
    return (F.when(distinct.isNull(), "unknown")
            .when(distinct <= 1, "constant")
            .when((share > 0.95) & (F.col("id_name") | text), "id")
            .when(F.col("kind") == DATETIME, "datetime")
            .when(text & (F.col("date_share") > rules.DATE_PARSE_SHARE), "datetime")
            .when(number & (distinct == 2), "binary")
            .when(number & (distinct <= 15), "categorical")
            .when(number, "numeric")
            .when(text & (distinct <= 20), "categorical")
            .when(text & (share > 0.5), "text")
            .when(text, "high_cardinality")
            .otherwise("unknown"))


def classify_columns(df: DataFrame, order_by: str | None = None, approx: bool = False) -> DataFrame:
    """Per column: tag, label, null_pct, n_distinct, n_rows and a sample value."""
    df = normalise(df)
    stats = column_metrics(df, [*NULL_METRICS, *DATE_LAYOUT_METRICS]).join(sample_values(df, order_by), "column")
    distinct = distinct_counts(df, approx=approx).select("position", "n_distinct")
    names = literal_table(df.sparkSession, [(n, is_id_name(n)) for n in df.columns], ROLE_SCHEMA)
    labels = F.create_map(*[F.lit(x) for pair in rules.TAG_LABELS.items() for x in pair])
    facts = (stats.withColumn("date_share", _date_share())
             .join(distinct, "position", "left").join(F.broadcast(names), "column"))
    tagged = facts.withColumn("tag", F.when(F.col("kind").isin(*ALL_KINDS[:4]), _role()).otherwise("unknown"))
    return tagged.select(
        "position", "column", "kind", "tag", labels[F.col("tag")].alias("label"),
        F.round(F.try_divide(F.col("nulls") * 100.0, F.col("n_rows")), 1).alias("null_pct"),
        "n_distinct", "n_rows", "sample")


def column_warnings(classified: DataFrame) -> DataFrame:
    """(tag, n_columns, columns) for id, constant and free-text columns."""
    return (classified.where(F.col("tag").isin("id", "constant", "text")).groupBy("tag")
            .agg(F.count(F.lit(1)).alias("n_columns"),
                 F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("columns")))


def encoding_advice(classified: DataFrame) -> DataFrame:
    """(column, tag, advice, detail)."""
    advice = literal_table(classified.sparkSession,
                           [(tag, *text) for tag, text in rules.ENCODING_ADVICE.items()],
                           "tag string, advice string, detail string")
    return classified.join(F.broadcast(advice), "tag").select("column", "tag", "advice", "detail")


def valid_targets(classified: DataFrame) -> DataFrame:
    """Columns that can serve as a target: not an id, a constant or free text."""
    return classified.where(~F.col("tag").isin("id", "constant", "text")).select("column", "tag")


def by_role(df: DataFrame, *tags: str) -> list[str]:
    """The columns with one of these roles, in their order: ``numeric`` for histograms, moments and boxes, ``numeric`` and ``binary`` for
    correlations, which take them where no columns are named."""
    found = classify_columns(df).where(F.col("tag").isin(*tags)).select("position", "column").collect()
    return [r.column for r in sorted(found)]

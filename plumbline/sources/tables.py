"""Readers and writers: CSV with type inference, Parquet, CSV export."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from plumbline import rules
from plumbline.functions.text import is_number_text, stripped
from plumbline.operators.columns import Metric, STRING, column_metrics, table_columns

EXPORT_SUFFIX = "_cleaned"
EXTRA_FIELD = "__extra_field"


def read_table(spark: SparkSession, path: str, format: str | None = None, *,
               encoding: str = "auto", infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Reads a CSV or Parquet table and checks that it holds data."""
    kind = format or next((k for k in ("csv", "parquet") if path.rstrip("/").lower().endswith("." + k)), None)
    if kind == "csv":
        df = read_csv(spark, path, encoding=encoding, infer=infer, multi_line=multi_line)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format: {path!r}; use a .csv or .parquet path or give format=")
    check_table(df)
    return df


def read_sources(spark: SparkSession, paths: dict[str, str] | list[str], source_column: str = "source", **options) -> DataFrame:
    """Several files as one table: columns are matched by name, those that a file lacks are null, and ``source_column``
    names the file, by its key or by its path. Types must agree or widen to a common one; ``options`` are those of ``read_table``."""
    named = paths if isinstance(paths, dict) else {p: p for p in paths}
    if not named:
        raise ValueError("no files to read")
    tables = [read_table(spark, path, **options).withColumn(source_column, F.lit(name)) for name, path in named.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def check_table(df: DataFrame) -> None:
    if not df.columns:
        raise ValueError("no columns: the file is blank or not formatted as a table")
    if df.isEmpty():
        raise ValueError("the table is empty: no rows found")


def read_csv(spark: SparkSession, path: str, *, encoding: str = "auto", infer: bool = True,
             multi_line: bool | None = None) -> DataFrame:
    """A CSV file or folder with a header row, as typed columns.

    One look at the raw lines decides two things: ``encoding="auto"`` takes Latin-1 if some
    line isn't valid UTF-8, and ``multi_line=None`` allows line breaks inside quotes if some
    line has an odd number of them. A file with such breaks is read by one task, so large
    ones belong in Parquet first. Types are inferred in one aggregate: whole number, decimal
    number, boolean or text; null tokens become null first. Short rows are filled with nulls,
    rows with too many fields are an error.
    """
    if encoding == "auto" or multi_line is None:
        raw_lines = _look(spark, path)
        encoding = ("ISO-8859-1" if raw_lines.broken else "UTF-8") if encoding == "auto" else encoding
        multi_line = bool(raw_lines.odd) if multi_line is None else multi_line

    def scan(charset: str) -> DataFrame:
        reader = (spark.read.option("header", True).option("encoding", charset)
                  .option("escape", '"').option("multiLine", multi_line))
        try:
            names = reader.csv(path).columns
        except PySparkException as error:
            raise ValueError(f"the CSV can't be read: {error}") from error
        if not names:
            raise ValueError("no columns: the file is blank or not formatted as a table")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, EXTRA_FIELD]])
        return reader.schema(schema).csv(path)

    raw = scan(encoding)
    names = [c for c in table_columns(raw) if c.name != EXTRA_FIELD]
    if not raw.where(F.col(EXTRA_FIELD).isNotNull()).limit(1).isEmpty():
        raise ValueError("the CSV can't be parsed: a row has more fields than the header")
    table = raw.select(*[F.when(~c.ref.isin(*rules.NULL_TOKENS), c.ref).alias(c.name) for c in names])
    return infer_types(table) if infer else table


def _look(spark: SparkSession, path: str) -> Row:
    """Whether some line isn't valid UTF-8, and whether one has an odd number of quotes; lines keep their bytes."""
    line = F.col("value")
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    try:
        return spark.read.text(path).agg(F.bool_or(~F.is_valid_utf8(line)).alias("broken"), F.bool_or(quotes % 2 == 1).alias("odd")).first()
    except PySparkException as error:
        raise ValueError(f"the CSV can't be read: {error}") from error


def _is_whole(text):
    return text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull()


def _is_bool(c):
    return c.isin("True", "False", "TRUE", "FALSE", "true", "false")


TYPE_METRICS = [
    Metric("present", "bigint", (STRING,), F.count),
    Metric("whole", "bigint", (STRING,), lambda c: F.count_if(_is_whole(c)), "text"),
    Metric("numeric", "bigint", (STRING,), lambda c: F.count_if(is_number_text(c)), "text"),
    Metric("booleans", "bigint", (STRING,), lambda c: F.count_if(_is_bool(c))),
]


def infer_types(df: DataFrame) -> DataFrame:
    """Casts each text column to the narrowest type all its non-null cells fit."""
    types = {}
    for row in column_metrics(df, TYPE_METRICS, table_columns(df, STRING)).collect():
        if row.present == 0:
            types[row.column] = "double"
        elif row.whole == row.present:
            types[row.column] = "bigint"
        elif row.numeric == row.present:
            types[row.column] = "double"
        elif row.booleans == row.present:
            types[row.column] = "boolean"
    return df.select(*[stripped(c.ref).cast(types[c.name]).alias(c.name) if c.name in types
                       else c.ref for c in table_columns(df)])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column, one file per partition."""
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def export_csv(df: DataFrame, folder: str, original_name: str, suffix: str = EXPORT_SUFFIX) -> str:
    """Writes the cleaned table beside its original name and returns the path."""
    stem = original_name.rsplit(".", 1)[0]
    path = f"{folder.rstrip('/')}/{stem}{suffix}.csv"
    write_csv(df, path)
    return path


def write_report(report: DataFrame, path: str) -> None:
    """The score report (one row per dimension and the final row) as one CSV file."""
    report.coalesce(1).sortWithinPartitions("position").drop("position").write.option("header", True).csv(path)

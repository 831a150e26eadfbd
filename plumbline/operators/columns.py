"""Column inventory, the entry normalisation, and the one-scan column metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.numeric import without_nan
from plumbline.functions.text import date_text, stripped

NUMBER, STRING, BOOLEAN, DATETIME, OTHER = "number", "string", "boolean", "datetime", "other"
ALL_KINDS = (NUMBER, STRING, BOOLEAN, DATETIME, OTHER)

# Columns per unpivot; wider tables take one scan per block, each of its own columns. The
# number is fixed, so the plan of a table doesn't depend on its size, and low enough for
# sketch aggregates, which fall back to sorting above 128 groups in a task.
COLUMNS_PER_SCAN = 6


@dataclass(frozen=True)
class TableColumn:
    position: int
    name: str
    dtype: str
    kind: str
    groupable: bool

    @property
    def ref(self) -> Column:
        return column_ref(self.name)

    @property
    def slot(self) -> str:
        return f"c{self.position}"

    @property
    def cell(self) -> Column:
        """The value in the one type that all columns of its family are unpivoted to."""
        if self.kind == NUMBER:
            return self.ref.cast("double")
        if self.kind == BOOLEAN:
            return self.ref.cast("int").cast("double")
        if self.kind == DATETIME:
            return self.ref.cast("timestamp")
        if self.kind == OTHER:
            return F.when(self.ref.isNotNull(), F.to_json(F.struct(self.ref.alias("v")), {"ignoreNullFields": "false"}))
        return self.ref


@dataclass(frozen=True)
class Metric:
    """An aggregate over the cells of each column whose kind is listed.

    ``build`` gets the cell: text, a double (numbers and booleans), a timestamp, or the
    JSON text of a nested value. With ``source="text"`` it gets stripped text, with
    ``source="short"`` text that may be a date.
    """

    name: str
    type: str
    kinds: tuple[str, ...]
    build: Callable[[Column], Column]
    source: str = "value"


def column_ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def _groupable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return False
    if isinstance(data_type, T.ArrayType):
        return _groupable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_groupable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, T.VariantType)


def table_columns(df: DataFrame, *kinds: str, names: Iterable[str] | None = None) -> list[TableColumn]:
    wanted = None if names is None else set(names)
    found = [TableColumn(i, f.name, f.dataType.simpleString(), _kind(f.dataType), _groupable(f.dataType))
             for i, f in enumerate(df.schema.fields)]
    return [c for c in found
            if (not kinds or c.kind in kinds) and (wanted is None or c.name in wanted)]


def canonical(value: Column, data_type: T.DataType) -> Column:
    """The value in a form that can be grouped: maps become sorted entries, variants their JSON text."""
    if _groupable(data_type):
        return value
    if isinstance(data_type, T.VariantType):
        return F.to_json(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(
            canonical(e["key"], data_type.keyType).alias("key"), canonical(e["value"], data_type.valueType).alias("value"))))
    fields = [canonical(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def normalise(df: DataFrame) -> DataFrame:
    """Makes NaN a null in float and double columns; one projection, no shuffle."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({n: without_nan(column_ref(n)).cast(df.schema[n].dataType) for n in floats})


def cells(df: DataFrame, columns: list[TableColumn], value: Callable[[TableColumn], Column] | None = None,
          keep: Iterable[str] = ()) -> DataFrame:
    """(slot, value): one row per cell of the given columns, nulls included; columns to ``keep`` come first.

    One scan of just these columns. Grouping by slot keeps the plan the same size for any
    number of columns, and is combined on the map side to a row per column and task.
    """
    slots = [(c.cell if value is None else value(c)).alias(c.slot) for c in columns]
    return df.select(*keep, *slots).unpivot(list(keep), [c.slot for c in columns], "slot", "value")


def blocks(columns: list, size: int = COLUMNS_PER_SCAN) -> list[list]:
    return [columns[i:i + size] for i in range(0, len(columns), size)]


def column_names(spark: SparkSession, columns: list[TableColumn]) -> DataFrame:
    """(slot, position, column, dtype, kind); one row per column."""
    return literal_table(spark, [(c.slot, c.position, c.name, c.dtype, c.kind) for c in columns],
                         "slot string, position int, column string, dtype string, kind string")


FAMILIES = ((STRING,), (NUMBER, BOOLEAN), (DATETIME,), (OTHER,))


def column_metrics(df: DataFrame, metrics: list[Metric], columns: list[TableColumn] | None = None) -> DataFrame:
    """One row per column: position, column, dtype, kind, n_rows and every metric.

    Metrics that don't apply to the kind of a column are null. Columns of one family share
    a grouped aggregate over their cells, so the plan doesn't grow with the columns.
    """
    columns = table_columns(df) if columns is None else columns
    parts = []
    for family in FAMILIES:
        used = [m for m in metrics if any(k in m.kinds for k in family)]
        aggregates = [(m.build(F.col(m.source)) if m in used else F.lit(None)).cast(m.type).alias(m.name) for m in metrics]
        for block in blocks([c for c in columns if c.kind in family]):
            data = cells(df, block)
            if family == (STRING,):
                data = data.withColumns({"text": stripped(F.col("value")), "short": date_text(F.col("value"))})
            parts.append(data.groupBy("slot").agg(F.count(F.lit(1)).alias("n_rows"), *aggregates))
    if not parts:
        return literal_table(df.sparkSession, [], "position int, column string, dtype string, kind string, n_rows bigint"
                             + "".join(f", {m.name} {m.type}" for m in metrics))
    names = F.broadcast(column_names(df.sparkSession, columns))
    kept = [F.when(F.col("kind").isin(*m.kinds), F.col(m.name)).alias(m.name) for m in metrics]
    return reduce(DataFrame.unionByName, parts).join(names, "slot").select(
        "position", "column", "dtype", "kind", "n_rows", *kept)


def merge_metrics(*groups: list[Metric]) -> list[Metric]:
    """The union of metric lists by name."""
    merged: dict[str, Metric] = {}
    for group in groups:
        for m in group:
            merged.setdefault(m.name, m)
    return list(merged.values())


def small_table(df: DataFrame) -> DataFrame:
    """Runs a summary now and keeps its rows as a local table.

    Only for results whose size is bounded by the number of columns. A local table
    needs no executor to survive and no second scan of the input.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return literal_table(df.sparkSession, [tuple(r) for r in df.collect()], schema)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local table of values known on the driver (one row per column or rule)."""
    parsed = T.StructType.fromDDL(schema)
    data = pa.Table.from_pylist([dict(zip(parsed.names, row)) for row in rows],
                                schema=to_arrow_schema(parsed))
    return spark.createDataFrame(data, parsed)


def count_cells(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.count_if(test(c))

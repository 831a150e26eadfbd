"""JSON lines as flat typed tables: one for the records, one for each array, and the lines that aren't JSON.

The schema is inferred from all lines. Objects become columns with dotted names, arrays side tables with the key of
their record and the position of each element; what an element holds is flattened in the same way, and arrays in
arrays have side tables of their own. A line that isn't a JSON object is kept with its text, never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.operators.columns import column_ref
from plumbline.sources.staging import staged

RECORD, POSITION, BAD = "record", "position", "__bad_line"


@dataclass(frozen=True)
class JsonTables:
    """``rows`` has ``record`` and the flat columns; ``sides`` the array tables by dotted name; ``bad`` the unreadable lines."""

    rows: DataFrame
    sides: dict[str, DataFrame]
    bad: DataFrame

    def report(self) -> DataFrame:
        """(table, n): how many rows each table has, bad lines included."""
        found = self.rows.agg(F.lit("rows").alias("table"), F.count("*").alias("n"))
        for name, side in self.sides.items():
            found = found.unionByName(side.agg(F.lit(name).alias("table"), F.count("*").alias("n")))
        return found.unionByName(self.bad.agg(F.lit("bad lines").alias("table"), F.count("*").alias("n")))


def _flat(value: Column, kind: T.DataType, name: str) -> tuple[list[Column], list[tuple[str, Column, T.ArrayType]]]:
    """The flat columns of a value and the arrays in it."""
    if isinstance(kind, T.StructType):
        columns, arrays = [], []
        for field in kind.fields:
            more, inner = _flat(value[field.name], field.dataType, f"{name}.{field.name}" if name else field.name)
            columns += more
            arrays += inner
        return columns, arrays
    if isinstance(kind, T.ArrayType):
        return [], [(name, value, kind)]
    return [value.alias(name)], []


def _sides(rows: DataFrame, arrays: list[tuple[str, Column, T.ArrayType]], keys: list[str]) -> dict[str, DataFrame]:
    found = {}
    for name, value, kind in arrays:
        places = [*keys, POSITION if len(keys) == 1 else f"{POSITION}{len(keys)}"]
        elements = rows.select(*keys, F.posexplode(value).alias(places[-1], "__element"))
        columns, inner = _flat(F.col("__element"), kind.elementType, "value" if not isinstance(kind.elementType, T.StructType) else "")
        found[name] = elements.select(*places, *columns)
        found |= {f"{name}.{n}": side for n, side in _sides(elements, inner, places).items()}
    return found


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> JsonTables:
    """Reads a file or folder of JSON lines. ``schema`` saves the pass that infers it; cells that don't fit it make a line bad."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    own = schema or reader.json(path).schema
    kept = [f for f in own.fields if f.name != BAD]
    raw = reader.schema(T.StructType([*kept, T.StructField(BAD, T.StringType())])).json(path)
    # Records are numbered and written once: side tables refer to these numbers, and bad lines need a table that isn't parsed again.
    lines = staged(raw.select(F.monotonically_increasing_id().alias(RECORD), F.struct(*[column_ref(f.name) for f in kept]).alias("__value")
                              if kept else F.lit(None).cast("struct<>").alias("__value"), column_ref(BAD)), "json")
    good = lines.where(column_ref(BAD).isNull())
    columns, arrays = _flat(F.col("__value"), T.StructType(kept), "")
    return JsonTables(good.select(RECORD, *columns), _sides(good, arrays, [RECORD]), lines.where(column_ref(BAD).isNotNull()).select(RECORD, column_ref(BAD).alias("line")))

"""Type conversion with rejects, and repair of texts.

``convert`` reads the table once: the converted table and the cells that couldn't be converted come from the same written pass, so
what is null in one is listed in the other with its row's key, its text and the reason.

``repair_text`` brings texts to Unicode normal form C, single blanks and no outer blanks, and undoes double encoding: UTF-8 bytes that
were read as Windows-1252 or Latin-1. A stretch is re-decoded only if all its bytes are UTF-8, and a pair only if it starts with the byte of an
accented Latin letter, so a text that merely holds such characters stays. Normal form C has no built-in function; that part is an Arrow transform over columns, without a shuffle.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from plumbline.functions.text import stripped
from plumbline.operators.columns import STRING, column_metrics, column_ref, Metric, table_columns
from plumbline.sources.staging import staged

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
WHOLE = ("tinyint", "smallint", "int", "bigint")
# The layouts that a text may have to become a date or a time, tried in this order.
TIME_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "yyyyMMdd", "d MMM yyyy", "MMM yyyy",
                "dd/MM/yyyy hh:mm a")
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
LEAST_SHARE = 0.95


def _number(text: Column) -> Column:
    """A number text without thousands separators."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3}(\D|$))", "")


def _converted(text: Column, kind: str) -> Column:
    if kind in WHOLE:
        number = _number(text)
        return F.when(number.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(number, r"\.0*$", "").try_cast(kind))
    if kind in NUMERIC:
        return _number(text).try_cast(kind)
    if kind == "boolean":
        return F.when(F.lower(text).isin(*TRUE), F.lit(True)).when(F.lower(text).isin(*FALSE), F.lit(False))
    if kind in ("date", "timestamp"):
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in TIME_LAYOUTS]).cast(kind)
    raise ValueError(f"no conversion to {kind!r}")


def _reason(text: Column, kind: str) -> Column:
    if kind in WHOLE:
        number = _number(text)
        return (F.when(number.rlike(r"^[+-]?\d+(\.0*)?$"), F.lit("out of range")).when(number.try_cast("double").isNotNull(), F.lit("has a fraction"))
                .otherwise(F.lit("not a number")))
    names = {"boolean": "not a truth value", "date": "not a date", "timestamp": "not a time"}
    return F.lit(names.get(kind, "not a number"))


def convert(df: DataFrame, types: dict[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """The table with the named columns in their new types, and the rejected cells (key, column, value, reason).

    Blank text becomes null and isn't rejected. Columns that aren't text are converted through their text form.
    """
    rejects = []
    new = {}
    for name, kind in types.items():
        text = stripped(column_ref(name).cast("string"))
        value = _converted(text, kind)
        new[name] = value
        rejects.append(F.when((text != "") & value.isNull(), F.struct(
            F.lit(name).alias("column"), column_ref(name).cast("string").alias("value"), _reason(text, kind).alias("reason"))))
    cells = [new.get(c.name, c.ref).alias(c.name) for c in table_columns(df)]
    # The row is one struct beside its key and rejects, so names can't clash.
    done = staged(df.select(F.struct(*cells).alias("row"), column_ref(key).alias("key"), F.filter(F.array(*rejects), lambda x: x.isNotNull()).alias("rejects")), "converted")
    return done.select("row.*"), done.select("key", F.inline("rejects"))


def suggested_types(df: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(column, filled, whole, number, truth, time, suggested) of every text column: the narrowest type that at least ``least_share`` of its cells convert to."""
    def share(kind: str):
        return lambda c: F.count_if(_converted(c, kind).isNotNull())
    metrics = [Metric("filled", "bigint", (STRING,), lambda c: F.count_if(c != ""), "text"), Metric("whole", "bigint", (STRING,), share("bigint"), "text"),
               Metric("number", "bigint", (STRING,), share("double"), "text"), Metric("truth", "bigint", (STRING,), share("boolean"), "text"),
               Metric("time", "bigint", (STRING,), share("timestamp"), "short")]
    found = column_metrics(df, metrics, table_columns(df, STRING))
    fits = [(k, F.col(c) >= least_share * F.col("filled")) for k, c in (("boolean", "truth"), ("bigint", "whole"), ("double", "number"), ("timestamp", "time"))]
    suggested = F.when(F.col("filled") == 0, F.lit("string"))
    for kind, test in fits:
        suggested = suggested.when(test, F.lit(kind))
    return found.select("position", "column", "filled", "whole", "number", "truth", "time", suggested.otherwise("string").alias("suggested"))


# What each byte from 0x80 on looks like when it is read as Windows-1252, or as Latin-1 where that has no character.
_READ_AS = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0xA0)}
_STRETCH = re.compile("[" + "".join(map(re.escape, _READ_AS)) + "]{2,}")


def undouble(text: str) -> str:
    """Every stretch that is UTF-8 read as single bytes, decoded; again while that changes something."""
    def decoded(match: re.Match) -> str:
        data = bytes(_READ_AS[c] for c in match.group())
        try:
            found = data.decode("utf-8")
        except UnicodeDecodeError:
            return match.group()
        # Two letters that happen to be the bytes of one: believed only where they start as accented letters do.
        return match.group() if len(data) == 2 and data[0] not in (0xC2, 0xC3) else found
    while True:
        found = _STRETCH.sub(decoded, text)
        if found == text:
            return text
        text = found


def repaired(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", undouble(text)).split())


def repair_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The table with repaired text columns (all, or those named); nulls stay null."""
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repaired, na_action="ignore")
    return df.withColumns({c.name: run(c.ref) for c in table_columns(df, STRING, names=columns)})


cloudpickle.register_pickle_by_value(sys.modules[__name__])

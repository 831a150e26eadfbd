"""Exact quantiles that never gather a column in one task.

``percentile`` keeps a map of all values of a column in a single task, which fails on
nearly unique columns of large tables. Instead each wanted rank is narrowed, as long as its
part of the column (the whole column at first) holds more than ``GATHER_LIMIT`` cells:

1. a KLL sketch of a row sample proposes two values around the rank,
2. one aggregate counts the cells below and at both values, which proves in which
   part the rank lies,
3. both repeat inside that part until at most ``GATHER_LIMIT`` cells are left, and
   these are sorted.

Sample and sketch only choose where to look; the counts make the result exact. A part
shrinks to well below 1 % each time, so 10^11 rows need three or four rounds and 10^6 one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.columns import DATETIME, TableColumn, blocks, cells, literal_table, table_columns

GATHER_LIMIT = 20_000
SKETCH_SIZE = 8192
SMALLEST_SAMPLE = 200_000
LARGEST_SAMPLE = 4_000_000


@dataclass
class _Rank:
    """One order statistic: the cell at ``rank`` lies strictly between low and high."""

    slot: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    @property
    def part(self) -> tuple:
        return self.slot, self.low, self.high

    def narrow(self, a: tuple[float, int, int], b: tuple[float, int, int]) -> None:
        """Moves into the part that holds the rank; a and b are (value, cells below, cells equal)."""
        (low, below_low, at_low), (high, below_high, at_high) = a, b
        end = self.below + self.inside
        if self.rank < below_low:
            self.high, self.inside = low, below_low - self.below
        elif self.rank < below_low + at_low:
            self.value = low
        elif self.rank < below_high:
            self.low, self.high, self.below = low, high, below_low + at_low
            self.inside = below_high - self.below
        elif self.rank < below_high + at_high:
            self.value = high
        else:
            self.low, self.below = high, below_high + at_high
            self.inside = end - self.below


@dataclass
class _Quantile:
    share: float = 0.0
    ranks: list[_Rank] = field(default_factory=list)

    def value(self) -> float | None:
        if not self.ranks:
            return None
        lower, upper = self.ranks[0].value, self.ranks[-1].value
        return lower if lower == upper else lower + (upper - lower) * self.share


def exact_quantiles(df: DataFrame, columns: list[TableColumn], probs: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column's non-null cells (null if none).

    Runs a few scans of the given columns and returns ``len(probs)`` numbers per column.
    Timestamps are handled as microseconds since 1970.
    """
    if not columns:
        return {}
    found = _quantiles(df, columns, probs)
    return {c.name: found[c.slot] for c in columns}


def _as_number(c: TableColumn) -> Column:
    if c.kind == DATETIME:
        return F.unix_micros(c.ref.cast("timestamp")).cast("double")
    return c.cell


def _cells(df: DataFrame, columns: list[TableColumn]) -> list[DataFrame]:
    return [cells(df, block, _as_number).where(F.col("value").isNotNull()) for block in blocks(columns)]


def _quantiles(df: DataFrame, columns: list[TableColumn], probs: list[float]) -> dict[str, list[float | None]]:
    data, n_rows = _cells(df, columns), df.count()
    wholes = {(c.slot, None, None): probs for c in columns}
    # The first look inside the whole columns; none of them can need it in a table this small.
    sketched = _sketch(data, wholes, n_rows) if n_rows > GATHER_LIMIT else {}
    marks = {c.slot: sorted({v for pair in sketched.get((c.slot, None, None), {}).values() for v in pair}) for c in columns}
    counts, sizes = _count(data, marks)
    quantiles: dict[str, list[_Quantile]] = {c.slot: [] for c in columns}
    for slot, listed in quantiles.items():
        n = sizes.get(slot, 0)
        for p in probs:
            q = _Quantile()
            listed.append(q)
            if n:
                at = (n - 1) * p
                q.share = at - math.floor(at)
                q.ranks = [_Rank(slot, r, n) for r in sorted({math.floor(at), min(math.ceil(at), n - 1)})]
                around = sketched.get((slot, None, None), {}).get(p)
                for r in q.ranks if around else []:
                    r.narrow(*[(v, *counts[(slot, v)]) for v in around])
    ranks = [r for listed in quantiles.values() for q in listed for r in q.ranks]
    while large := [r for r in ranks if r.value is None and r.inside > GATHER_LIMIT]:
        _narrow(data, large)
    _gather(data, [r for r in ranks if r.value is None])
    return {slot: [q.value() for q in listed] for slot, listed in quantiles.items()}


def _per_slot(parts: list[tuple]) -> tuple[dict[str, list[tuple]], int]:
    """Groups (slot, ...) tuples by slot and gives the largest group size."""
    grouped: dict[str, list[tuple]] = {}
    for slot, *rest in parts:
        grouped.setdefault(slot, []).append(tuple(rest))
    return grouped, max(map(len, grouped.values()))


def _between(low: Column, high: Column) -> Column:
    value = F.col("value")
    return (low.isNull() | (value > low)) & (high.isNull() | (value < high))


def _in_parts(data: list[DataFrame], parts: list[tuple]) -> DataFrame:
    """The cells inside each part, tagged with its index; the parts are a few per column.

    The bounds of a column's parts sit side by side in one row, so that the test for any
    of them comes before a cell is repeated for each part it is in.
    """
    spark = data[0].sparkSession
    grouped, width = _per_slot(parts)
    nowhere = (math.inf, -math.inf)
    wide = [(slot, *[x for p in ps + [nowhere] * (width - len(ps)) for x in p]) for slot, ps in grouped.items()]
    bounds = F.broadcast(literal_table(
        spark, wide, "slot string" + "".join(f", low{i} double, high{i} double" for i in range(width))))
    inside = reduce(or_, [_between(F.col(f"low{i}"), F.col(f"high{i}")) for i in range(width)])
    somewhere = reduce(DataFrame.unionByName,
                       [part.join(bounds, "slot").where(inside).select("slot", "value") for part in data])
    table = literal_table(spark, [(i, *part) for i, part in enumerate(parts)],
                          "part int, slot string, low double, high double")
    return somewhere.join(F.broadcast(table), "slot").where(_between(F.col("low"), F.col("high")))


def _sketch(data: list[DataFrame], points: dict[tuple, list[float]], n_cells: int) -> dict[tuple, dict]:
    """Per part and share: two sketched values around it. The sample follows the size."""
    size = min(n_cells, max(SMALLEST_SAMPLE, min(LARGEST_SAMPLE, n_cells // 1000)))
    margin = 1.5 / math.sqrt(size) + 0.0007
    parts = list(points)
    whole = all(low is None and high is None for _, low, high in parts)
    key = "slot" if whole else "part"
    tagged = data if whole else [_in_parts(data, parts)]
    index = {part[0]: part for part in parts} if whole else dict(enumerate(parts))
    if size < n_cells:
        tagged = [part.where(F.rand(7) < size / n_cells) for part in tagged]
    shares = sorted({x for listed in points.values() for s in listed for x in (max(0.0, s - margin), min(1.0, s + margin))})
    sketches = reduce(DataFrame.unionByName, [
        part.groupBy(key).agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_SIZE)).alias("sketch")) for part in tagged])
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(x) for x in shares])).alias("values")
    result = {}
    for row in sketches.select(key, values).collect():
        at, part = dict(zip(shares, row["values"])), index[row[key]]
        result[part] = {s: (at[max(0.0, s - margin)], at[min(1.0, s + margin)]) for s in points[part]}
    return result


def _count(data: list[DataFrame], marks: dict[str, list[float]]) -> tuple[dict[tuple, tuple[int, int]], dict[str, int]]:
    """The cells below and at each mark, and the non-null cells of each column; one scan.

    Each cell gets the number of its step: 2i between marks i-1 and i, 2i+1 at mark i.
    """
    width = max(map(len, marks.values()))
    wide = [(slot, *vs, *[None] * (width - len(vs))) for slot, vs in marks.items()]
    table = F.broadcast(literal_table(data[0].sparkSession, wide,
                                      "slot string" + "".join(f", mark{i} double" for i in range(width))))
    value, step = F.col("value"), F.lit(0)
    for i in range(width):
        mark = F.col(f"mark{i}")
        step = step + F.coalesce((value >= mark).cast("int"), F.lit(0)) + F.coalesce((value > mark).cast("int"), F.lit(0))
    counted = reduce(DataFrame.unionByName, [
        part.join(table, "slot").groupBy("slot", step.alias("step")).agg(F.count(F.lit(1)).alias("n")) for part in data])
    steps = {(r.slot, r.step): r.n for r in counted.collect()}
    counts, sizes = {}, {}
    for slot, values in marks.items():
        below = 0
        for i, v in enumerate(values):
            below += steps.get((slot, 2 * i), 0)
            equal = steps.get((slot, 2 * i + 1), 0)
            counts[(slot, v)] = (below, equal)
            below += equal
        sizes[slot] = below + steps.get((slot, 2 * len(values)), 0)
    return counts, sizes


def _narrow(data: list[DataFrame], ranks: list[_Rank]) -> None:
    """One round: sketch inside the parts of the ranks, count, and move each rank."""
    shares = {id(r): (r.rank - r.below) / max(1, r.inside - 1) for r in ranks}
    points: dict[tuple, list[float]] = {}
    for r in ranks:
        points.setdefault(r.part, []).append(shares[id(r)])
    # The smallest part decides the sampling rate, so that each part has enough rows.
    sketched = _sketch(data, points, min(r.inside for r in ranks))
    found = {id(r): sketched.get(r.part, {}).get(shares[id(r)]) for r in ranks}
    marks: dict[str, set[float]] = {}
    for r in ranks:
        marks.setdefault(r.slot, set()).update(found[id(r)] or ())
    counts, _ = _count(data, {slot: sorted(values) for slot, values in marks.items()})
    for r in ranks:
        if found[id(r)]:
            r.narrow(*[(v, *counts[(r.slot, v)]) for v in found[id(r)]])


def _gather(data: list[DataFrame], ranks: list[_Rank]) -> None:
    """Sorts the at most ``GATHER_LIMIT`` cells left per part and takes the ranks."""
    if not ranks:
        return
    parts = list({r.part for r in ranks})
    wanted = literal_table(data[0].sparkSession,
                           [(i, parts.index(r.part), r.rank - r.below + 1) for i, r in enumerate(ranks)],
                           "rank int, part int, place int")
    ordered = _in_parts(data, parts).groupBy("part").agg(F.sort_array(F.collect_list("value")).alias("ordered"))
    picked = ordered.join(F.broadcast(wanted), "part").select("rank", F.element_at("ordered", F.col("place")).alias("value"))
    for row in picked.collect():
        ranks[row["rank"]].value = row.value


def quantile_table(df: DataFrame, columns: list[TableColumn] | None, probs: dict[str, float]) -> DataFrame:
    """(column, <one column per named quantile>) as a small local table."""
    columns = table_columns(df, "number") if columns is None else columns
    found = exact_quantiles(df, columns, list(probs.values()))
    schema = "column string" + "".join(f", {name} double" for name in probs)
    return literal_table(df.sparkSession, [(c.name, *found[c.name]) for c in columns], schema)

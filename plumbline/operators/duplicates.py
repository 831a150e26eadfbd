"""Exact duplicate rows, identical columns and near-duplicate rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import rules
from plumbline.functions.text import group_key
from plumbline.operators.columns import (
    ALL_KINDS, NUMBER, OTHER, STRING, Metric, TableColumn,
    canonical, column_metrics, literal_table, table_columns,
)
from plumbline.sources.staging import staged


# Comparisons per scan of the columns they need.
PAIRS_PER_SCAN = 160


def _row_key(df: DataFrame, c: TableColumn) -> Column:
    return group_key(c.ref) if c.kind == STRING else canonical(c.ref, df.schema[c.name].dataType)


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_distinct_rows, duplicate_rows (copies after the first).

    Groups by all columns with long texts as digests, so the shuffle carries short
    keys, and equal rows are merged before it.
    """
    keys = [_row_key(df, c).alias(f"k{c.position}") for c in table_columns(df)]
    groups = df.select(*keys).groupBy(*[f"k{c.position}" for c in table_columns(df)]).count()
    return groups.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct_rows"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


# Digests of repeated rows that may be broadcast: 16 MB.
BROADCAST_DIGESTS = 2_000_000


def _row_digest(df: DataFrame) -> Column | None:
    """A digest that equal rows share, of the columns whose equality it follows; None where there is no such column."""
    flat = [c for c in table_columns(df) if c.kind != OTHER]
    # Minus zero equals zero in a grouping, so it must have the same digest.
    keys = [F.when(c.ref.isNotNull(), c.ref + F.lit(0).cast(c.dtype)) if c.dtype in ("float", "double") else c.ref for c in flat]
    return F.xxhash64(*keys) if keys else None


def repeated_and_single(df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows whose digest occurs more than once, and the rest, which have no copy; (None, None) where digests don't help.

    Counting 8-byte digests is one narrow shuffle; the repeated ones are broadcast if there are few enough, so rows without a copy are never
    shuffled. A digest that unequal rows share only sends them to be compared.
    """
    digest = _row_digest(df)
    if digest is None:
        return None, None
    counts = df.select(digest.alias("__digest")).groupBy("__digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__digest")
    many = staged(counts, "repeated")
    if many.limit(BROADCAST_DIGESTS + 1).count() > BROADCAST_DIGESTS:
        return None, None
    return df.join(F.broadcast(many), digest == many["__digest"], "left_semi"), df.join(F.broadcast(many), digest == many["__digest"], "left_anti")


def duplicate_members(df: DataFrame, order_by: list[str], limit: int = rules.DISPLAY_ROWS) -> DataFrame:
    """The first ``limit`` rows that have a copy, copies included, in the given order.

    Members of a group are equal, so they are repeated from the group (at most
    ``limit`` times) and not joined back.
    """
    names = df.columns
    repeated, _ = repeated_and_single(df)
    grouped = (df if repeated is None else repeated).groupBy(*[c.ref for c in table_columns(df)]).agg(F.count(F.lit(1)).alias("copies"))
    first = (grouped.where(F.col("copies") > 1)
             .orderBy(*order_by).limit(limit))
    repeated = first.select(*names, "copies", F.explode(F.sequence(
        F.lit(1), F.least(F.col("copies"), F.lit(limit)).cast("int"))).alias("copy"))
    return repeated.orderBy(*order_by, "copy").limit(limit).select(*names, "copies")


FINGERPRINT = [
    Metric("nulls", "bigint", ALL_KINDS, lambda c: F.count_if(c.isNull())),
    Metric("fingerprint", "bigint", ALL_KINDS, lambda c: F.bit_xor(F.xxhash64(c))),
]


def identical_columns(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(column_a, column_b): pairs of one type with equal values in every row.

    An order-free fingerprint of the values leaves some candidates, a second one that ties
    each value to its row fewer; only these are compared row by row, in one aggregate per
    block of pairs.
    """
    columns = [c for c in table_columns(df) if c.groupable]
    seen: dict[tuple, list[TableColumn]] = {}
    by_name = {c.position: c for c in columns}
    stats = column_metrics(df, FINGERPRINT, columns) if stats is None else stats
    for row in stats.select("position", "dtype", "nulls", "fingerprint").collect():
        if row.position not in by_name:
            continue
        seen.setdefault((row.dtype, row.nulls, row.fingerprint), []).append(by_name[row.position])
    seen = _same_places(df, [c for group in seen.values() if len(group) > 1 for c in group])
    pairs = [pair for group in seen.values()
             for pair in combinations(sorted(group, key=lambda c: c.position), 2)]
    confirmed = []
    for i in range(0, len(pairs), PAIRS_PER_SCAN):
        block = pairs[i:i + PAIRS_PER_SCAN]
        row = df.agg(*[F.bool_and(a.ref.eqNullSafe(b.ref)).alias(f"p{j}")
                       for j, (a, b) in enumerate(block)]).first()
        confirmed += [(a.name, b.name) for j, (a, b) in enumerate(block) if row[f"p{j}"] is not False]
    return literal_table(df.sparkSession, confirmed, "column_a string, column_b string")


def _same_places(df: DataFrame, columns: list[TableColumn]) -> dict[tuple, list[TableColumn]]:
    """Columns by the sum of their cells' hashes, each mixed with the hash of its row."""
    row = F.xxhash64(*[c.ref for c in columns])
    groups: dict[tuple, list[TableColumn]] = {}
    for i in range(0, len(columns), PAIRS_PER_SCAN):
        block = columns[i:i + PAIRS_PER_SCAN]
        sums = df.agg(*[F.sum(F.xxhash64(row, c.ref).cast("decimal(38,0)")).alias(c.slot) for c in block]).first()
        for c in block:
            groups.setdefault((c.dtype, sums[c.slot]), []).append(c)
    return groups


# Grid widths of the near-duplicate search, in the unit of the data. Whole numbers and
# decimals with up to four (coarse) or five (fine) places lie in the middle of a cell.
COARSE_WIDTH = 1e-4
FINE_WIDTH = 5e-6
CROWDED_CELL = 200
# Columns of a grid: a box lies in at most two cells a column, so in eight at most.
KEY_COLUMNS = 3
# Above this size neighbouring doubles are further apart than a sub-cell can resolve.
LARGE_NUMBER = 1e8


def near_duplicates(df: DataFrame, columns: list[str] | None = None,
                    distance: float = rules.NEAR_DISTANCE) -> DataFrame:
    """One row: n_rows (those without a null number), near_rows, near_pct.

    A row is near if another row lies closer than ``distance`` in the space of all
    number columns; an exact copy counts. No group of rows is ever paired up whole:

    * rows are grouped into sub-cells whose diagonal is below ``distance``. A sub-cell
      with two rows settles all of them, however many it holds;
    * each sub-cell leaves one row, its bounding box. Lone rows look for boxes in the
      same cell of a coarser grid over three columns with a semi-join. Lone rows in crowded
      cells look again in the grid over the next three columns, and at last in finer grids;
    * a box whose distance to a lone row is not certain (several different points in it)
      is opened, and only then are single rows compared.
    """
    numbers = table_columns(df, NUMBER, names=columns)
    if not numbers:
        return literal_table(df.sparkSession, [(0, 0, 0.0)], "n_rows bigint, near_rows bigint, near_pct double")
    xs = [f"x{c.position}" for c in numbers]
    rows = df.select(*[(c.ref.cast("double") + F.lit(0.0)).alias(x) for c, x in zip(numbers, xs)]).na.drop("any")
    rows = rows.select(*xs, *_sub_cell(xs, distance))
    subs = _names("s", xs)
    boxes = staged(rows.groupBy(*subs).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs]), "boxes")
    totals = boxes.agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("rows") > 1, F.col("rows"))).alias("near")).first()
    found = (totals.near or 0) + _near_lone_rows(rows, boxes, xs, distance)
    n = totals.n or 0
    return literal_table(df.sparkSession, [(n, found, 100.0 * found / n if n else 0.0)],
                         "n_rows bigint, near_rows bigint, near_pct double")


def _names(prefix: str, xs: list[str]) -> list[str]:
    return [f"{prefix}_{x}" for x in xs]


def _sub_cell(xs: list[str], distance: float) -> list[Column]:
    side = 0.99 * distance / len(xs) ** 0.5
    # Large numbers stand for themselves, scaled (exactly) out of the range of the cells.
    return [F.when(F.abs(x) < LARGE_NUMBER, _cell(F.col(x), side))
            .otherwise(F.col(x) * F.lit(2.0 ** 40)).alias(s) for x, s in zip(xs, _names("s", xs))]


def _cell(c: Column, width: float) -> Column:
    return F.rint(c / F.lit(width)) + F.lit(0.0)


def _home(xs: list[str], width: float) -> Column:
    key = F.lit(0).cast("bigint")
    for x in xs:
        key = F.xxhash64(key, _cell(F.col(f"lo_{x}"), width))
    return key


def _placed(boxes: DataFrame, xs: list[str], width: float, distance: float) -> DataFrame:
    """Each box in every cell that it or its surroundings touch: two per column at most."""
    placed = boxes.withColumn("cell", F.lit(0).cast("bigint"))
    for x in xs:
        touched = F.array_distinct(F.array(_cell(F.col(f"lo_{x}") - distance, width),
                                           _cell(F.col(f"hi_{x}") + distance, width)))
        placed = (placed.withColumn("step", F.explode(touched))
                  .withColumn("cell", F.xxhash64("cell", "step")).drop("step"))
    return placed


def _key_groups(boxes: DataFrame, xs: list[str]) -> list[list[str]]:
    """The columns in groups of ``KEY_COLUMNS``, those with the most cells first."""
    row = boxes.agg(*[F.approx_count_distinct(_cell(F.col(f"lo_{x}"), COARSE_WIDTH)).alias(x) for x in xs]).first()
    ordered = sorted(xs, key=lambda x: -row[x])
    return [ordered[i:i + KEY_COLUMNS] for i in range(0, len(ordered), KEY_COLUMNS)]


def _near_lone_rows(rows: DataFrame, boxes: DataFrame, xs: list[str], distance: float) -> int:
    """A row and a box close to it share a cell in the grid over any group of columns. Lone rows in
    crowded cells go on to the grid over the next columns, and at last to the finer grids."""
    lone, among, found = boxes.where(F.col("rows") == 1), boxes, 0
    groups = _key_groups(boxes, xs)
    grids = [(key, width) for width in (COARSE_WIDTH, FINE_WIDTH) for key in groups]
    for key, width in grids:
        placed = _placed(among, key, width, distance)
        homed = lone.withColumn("cell", _home(key, width))
        crowded = placed.groupBy("cell").count().where(F.col("count") > CROWDED_CELL).select("cell")
        if (key, width) == grids[-1] or crowded.isEmpty():
            break
        crowded = staged(crowded, "crowded")
        found += _search(rows, homed.join(crowded, "cell", "left_anti"), placed, xs, distance)
        lone = staged(homed.join(crowded, "cell", "left_semi").drop("cell"), "lone")
        among = staged(placed.join(crowded, "cell", "left_semi").drop("cell").distinct(), "among")
    return found + _search(rows, homed, placed, xs, distance)


def _search(rows: DataFrame, lone: DataFrame, placed: DataFrame, xs: list[str], distance: float) -> int:
    subs = _names("s", xs)
    limit = F.lit(distance)
    a, b = lone.alias("a"), placed.alias("b")
    gaps, reaches, differ = [], [], F.lit(False)
    for x, s in zip(xs, subs):
        at, low, high = F.col(f"a.lo_{x}"), F.col(f"b.lo_{x}"), F.col(f"b.hi_{x}")
        gap = F.greatest(low - at, at - high, F.lit(0.0))
        reach = F.greatest(F.abs(at - low), F.abs(at - high))
        gaps.append(gap * gap)
        reaches.append(reach * reach)
        differ = differ | (F.col(f"a.{s}") != F.col(f"b.{s}"))
    same_cell = (F.col("a.cell") == F.col("b.cell")) & differ
    certain = F.sqrt(sum(reaches[1:], reaches[0])) < limit
    possible = F.sqrt(sum(gaps[1:], gaps[0])) < limit
    sure = a.join(b, same_cell & certain, "left_semi").count()
    # In one dimension the ends of a box are rows, so the gap itself decides.
    if len(xs) == 1:
        return a.join(b, same_cell & possible, "left_semi").count()
    open_pairs = (a.join(b, same_cell & certain, "left_anti").alias("a")
                  .join(b.where(F.col("b.rows") > 1), same_cell & possible)
                  .select(*[F.col(f"a.lo_{x}").alias(f"at_{x}") for x in xs],
                          *[F.col(f"b.{s}").alias(s) for s in subs]))
    if open_pairs.isEmpty():
        return sure
    apart = [(F.col(f"at_{x}") - F.col(x)) ** 2 for x in xs]
    opened = (staged(open_pairs, "open_pairs").join(rows, subs)
              .where(F.sqrt(sum(apart[1:], apart[0])) < limit)
              .select(*_names("at", xs)).distinct().count())
    return sure + opened

"""The row at rank k by counting, without sorting: histograms over ever smaller ranges of exact units.

A first pass counts rows by sign and number of digits. Each further pass cuts the range that holds a
wanted rank into buckets, and goes on with the bucket it falls into, until one value is left. What
comes back from a pass is a count, a minimum and a maximum per bucket; rows are neither shuffled nor
sorted, and the passes grow with the logarithm of the rows, not with k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeline.functions.amounts import UNITS

BUCKETS = 1024


@dataclass(frozen=True)
class Place:
    """The value at a rank (NULLs come last), how many rows are above it and how many have it."""

    value: Decimal | None
    above: int
    ties: int


@dataclass
class _Range:
    low: Decimal
    high: Decimal
    above: int
    rows: int


def _find(cells: Sequence[tuple[Decimal, Decimal, int]], rank: int, above: int) -> _Range | None:
    """The cell (low, high, rows) with the rank, if the cells' rows are put in falling order."""
    for low, high, rows in sorted(cells, reverse=True):
        if above + rows >= rank:
            return _Range(low, high, above, rows)
        above += rows
    return None


def places(df: DataFrame, value: str, wanted: Mapping[str, tuple[Column, int]], buckets: int = BUCKETS) -> dict[str, Place]:
    """The place of each ``wanted`` entry, a condition on the rows and a rank among them (1 is the largest).

    ``value`` is a whole number of at most 38 digits. Conditions of different entries are equal or
    exclude each other; as each is one branch of an expression there may be some hundreds of them.
    """
    conditions: dict[str, Column] = {str(c): c for c, _ in wanted.values()}
    names = list(conditions)
    of = {key: names.index(str(c)) for key, (c, _) in wanted.items()}
    units = F.col(value).cast(UNITS)
    group = F.lit(None).cast("int")
    for i, name in enumerate(names):
        group = F.when(conditions[name], i).otherwise(group)
    rows = df.where(units.isNotNull()).select(units.alias("units"), group.alias("group")).where("group IS NOT NULL")
    figures = F.count(F.lit(1)).alias("rows"), F.min("units").alias("low"), F.max("units").alias("high")

    # Not by F.abs: that rounds to 34 digits.
    digits = F.length(F.translate(F.col("units").cast("string"), "-", ""))
    digits = F.when(F.col("units") < 0, -digits).when(F.col("units") > 0, digits).otherwise(0)
    cells: dict[int, list[tuple[Decimal, Decimal, int]]] = {}
    for r in rows.groupBy("group", digits.alias("digits")).agg(*figures).collect():
        cells.setdefault(r["group"], []).append((r["low"], r["high"], r["rows"]))
    ranges = {key: _find(cells.get(of[key], []), rank, 0) for key, (_, rank) in wanted.items()}

    while True:
        open_ = {(of[k], r.low, r.high) for k, r in ranges.items() if r is not None and r.low < r.high}
        if not open_:
            break
        number = {cell: i for i, cell in enumerate(sorted(open_))}
        cell, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
        for (g, low, high), i in number.items():
            inside = (F.col("group") == g) & F.col("units").between(F.lit(low), F.lit(high))
            cell = F.when(inside, i).otherwise(cell)
            # Any rising function will do: the next range is what was seen in a bucket.
            part = (F.col("units") - F.lit(low)).cast("double") * float(buckets / (high - low + 1))
            bucket = F.when(inside, F.floor(part).cast("int")).otherwise(bucket)
        counted = rows.select("units", cell.alias("cell"), bucket.alias("bucket")).where("cell IS NOT NULL")
        found: dict[int, list[tuple[Decimal, Decimal, int]]] = {}
        for r in counted.groupBy("cell", "bucket").agg(*figures).collect():
            found.setdefault(r["cell"], []).append((r["low"], r["high"], r["rows"]))
        for key, r in ranges.items():
            if r is not None and r.low < r.high:
                ranges[key] = _find(found[number[of[key], r.low, r.high]], wanted[key][1], r.above)
    return {
        key: Place(None, 0, 0) if r is None else Place(r.low, r.above, r.rows)
        for key, r in ranges.items()
    }


def values_at_ranks(
    df: DataFrame, ks: Sequence[int], by: str, order: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """``by, k`` and the ``order`` columns of the row at rank k of each group, for a few groups.

    Rows are ranked by the ``order`` columns, whole numbers, each falling with NULLs last. Beyond the
    first column the search goes on among the rows that tie. A rank beyond the last row has no row.
    """
    groups = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).collect()
    found = {(g[by], k): (F.col(by).eqNullSafe(F.lit(g[by])), k, []) for g in groups for k in ks if k <= g["rows"]}
    for column in order:
        asked = {repr(key): (condition, rank) for key, (condition, rank, _) in found.items()}
        at = places(df, column, asked, buckets)
        counts = _null_starts(df, column, found) if any(p.value is None for p in at.values()) else {}
        for key, (condition, rank, values) in found.items():
            place = at[repr(key)]
            if place.value is None:
                condition, rank = condition & F.col(column).isNull(), rank - counts[key]
            else:
                condition = condition & (F.col(column) == F.lit(place.value))
                rank -= place.above
            found[key] = condition, rank, [*values, place.value]
    types = [df.schema[c].dataType for c in order]
    rows = [(group, k, *values) for (group, k), (_, _, values) in found.items()]
    schema = f"`{by}` {df.schema[by].dataType.simpleString()}, k int, " + ", ".join(f"`{c}` decimal(38,0)" for c in order)
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.select(by, "k", *[F.col(c).cast(t).alias(c) for c, t in zip(order, types)])


def _null_starts(df: DataFrame, column: str, found: Mapping) -> dict:
    """How many rows of each entry's condition are not NULL in ``column``."""
    known = df.agg(
        *[F.count(F.when(c & F.col(column).isNotNull(), 1)).alias(str(i)) for i, (c, _, _) in enumerate(found.values())]
    ).first()
    return dict(zip(found, known))

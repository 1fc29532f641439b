"""Token amounts are exact base units (DECIMAL(38,0)) until the last projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = T.DecimalType(38, 0)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_units(value: Column) -> Column:
    """Base units from any numeric or digit-string column; amounts over 38 digits raise."""
    units = value.try_cast(UNITS)
    return F.when(
        value.isNotNull() & units.isNull(),
        F.raise_error(F.concat(F.lit("amount over 38 digits: "), value.cast("string"))).cast(UNITS),
    ).otherwise(units)


def to_tokens(units: Column | str, decimals: int = 18) -> Column:
    """Base units as a DOUBLE number of tokens."""
    return _col(units).cast("double") / F.lit(float(10**decimals))


def share(part: Column | str, total: Column | str) -> Column:
    """``part / total`` as one division of exact sums; NULL for a zero total."""
    return F.try_divide(_col(part).cast("double"), _col(total).cast("double"))


def change_ratio(change: Column | str, base: Column | str) -> Column:
    """``change / base``; NULL for a zero base."""
    return _col(change).cast("double") / F.nullif(_col(base).cast("double"), F.lit(0.0))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(_col(text), F.lit(""))

"""Tables laid out for the ledger: bucketed by (chain, address), so that joins and sums on it move nothing.

Raw transfers should not be bucketed by address: all rows of a busy one would be one task's. What is
laid out instead are the sums of its legs per period, of which it has as many as there are periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeline.functions.amounts import UNITS
from stakeline.operators.history import legs_of, period_start

KEYS = ("chain", "delegator")


def write_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Save ``df`` as a catalog table of ``buckets`` buckets by ``keys``, sorted by them, and read it.

    Rows are dealt as the buckets need before they are written, so each bucket is one file. With
    ``path`` the table's files lie there, else in the warehouse. An existing table is not replaced.
    """
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def period_legs(transfers: DataFrame, period: str = "MONTH") -> DataFrame:
    """Sums of legs per address and period: chain, delegator, period_start, units (NULL if none has an amount).

    A sum over 38 digits raises. Legs without a time have a NULL period. ``ledger_balances`` over
    these rows, with ``legs=period_units``, is the ledger of the transfers.
    """
    start = period_start(F.col("evt_block_time"), period).alias("period_start")
    return legs_of(transfers).groupBy(*KEYS, start).agg(F.sum("units").cast(UNITS).alias("units"))


def period_units(sums: DataFrame) -> DataFrame:
    """The legs of ``ledger_balances`` where they are period sums."""
    return sums.select(*KEYS, "units")

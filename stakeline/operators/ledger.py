"""Balances from the full transfer history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeline.functions.addresses import to_text
from stakeline.functions.amounts import UNITS, to_tokens
from stakeline.scale import BROADCAST_ROWS, Sized, aggregate_for


def debits(transfers: DataFrame) -> DataFrame:
    """Sent amounts as negative units: chain, delegator, units."""
    return transfers.select("chain", F.col("from").alias("delegator"), (-F.col("value")).alias("units"))


def credits(transfers: DataFrame) -> DataFrame:
    """Received amounts: chain, delegator, units."""
    return transfers.select("chain", F.col("to").alias("delegator"), F.col("value").alias("units"))


def signed_legs(transfers: DataFrame) -> DataFrame:
    """Both legs of every transfer from a single scan."""
    return transfers.selectExpr(
        "chain", "stack(2, `from`, -value, `to`, value) AS (delegator, units)"
    )


def ledger_balances(
    transfers: DataFrame,
    holders: Sized,
    decimals: int = 18,
    legs=signed_legs,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Credits minus debits of the distinct (chain, delegator) pairs in ``holders``.

    Holders without a transfer are absent, balances may be negative, a self-transfer nets zero.
    ``units`` is exact; ``w_delegated`` is the same in tokens. Other columns of ``holders`` stay,
    so current delegations become holdings. ``legs`` may be ``debits`` or ``credits`` for one side
    only.
    """
    summed = aggregate_for(
        legs(transfers),
        holders,
        ["chain", "delegator"],
        F.try_sum("units").alias("units"),
        F.count("units").alias("_legs"),
        broadcast_rows=broadcast_rows,
    )
    # A sum that overflows is NULL, and stops the run only if somebody asked for it.
    overflow = F.raise_error(F.concat(F.lit("balance over 38 digits: "), to_text("delegator"))).cast(UNITS)
    units = F.when(F.col("units").isNull() & (F.col("_legs") > 0), overflow).otherwise(F.col("units"))
    return (
        summed.withColumn("units", units).drop("_legs").withColumn("w_delegated", to_tokens("units", decimals))
    )

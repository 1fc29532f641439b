"""Delegations and balances as running aggregates of event streams.

Where the history is too long to rescan for every report, these keep the same figures current:
``max`` and ``sum`` do not depend on arrival order, so late events need no watermark and none are
dropped. State is one row per (chain, address) and lives in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stakeline.operators.ledger import signed_legs
from stakeline.operators.snapshots import EVENT_ORDER


def running_delegations(changes: DataFrame) -> DataFrame:
    """Latest event per (chain, delegator) of a delegation stream."""
    latest = F.max(F.struct(*EVENT_ORDER, "to_delegate")).alias("last")
    return (
        changes.groupBy("chain", "delegator")
        .agg(latest)
        .select("chain", "delegator", "last.to_delegate", "last.evt_block_time")
    )


def running_ledger(transfers: DataFrame) -> DataFrame:
    """Credits minus debits per (chain, delegator) of a transfer stream, every address."""
    return signed_legs(transfers).groupBy("chain", "delegator").agg(F.sum("units").alias("units"))


def keep(
    state: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Hand each batch of changed rows to ``apply`` (an upsert on chain and delegator)."""
    return (
        state.writeStream.outputMode("update")
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

"""Current state from append-only events: the latest row per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeline.functions.amounts import to_tokens
from stakeline.functions.times import DAY, SECOND, before, dated, elapsed_days, up_to
from stakeline.scale import pin, small

# Log position of an event. Time alone ties within a block, so block and index follow it.
EVENT_ORDER = ("evt_block_time", "evt_block_number", "evt_index")
LOG_ORDER = ("evt_block_number", "evt_index")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ties: str = "first"
) -> DataFrame:
    """Rows with the highest ``order`` per key: one row, or all tied rows with ``ties="all"``.

    Spark cuts each map task to its own winners ahead of the shuffle, so a key with any number of
    events sends one row per task. With ``ties="all"`` the highest order of each key is an aggregate
    that the map tasks begin, and the rows that have it are looked up: by broadcast if few keys have
    any rows, else by a join that adaptive execution can split. So the tied rows of a key need not
    meet in one task.
    """
    if ties == "first":
        window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
        return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")
    # In a comparison of structs NULL is the lowest, as it is with NULLS LAST in a falling order.
    tops = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(F.struct(*order)).alias("_top"))
    tops = small(pin(tops, "tops"))
    same = F.struct(*order).eqNullSafe(F.col("_top"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(tops, same, "left_semi")


def current_delegations(
    changes: DataFrame,
    as_of: str | datetime,
    order: Sequence[str] = EVENT_ORDER,
    with_time: bool = True,
    must_be_dated: bool = False,
) -> DataFrame:
    """Who each (chain, delegator) delegates to at ``as_of``, and since when; later events don't count.

    An event without a time counts, or is refused if they ``must_be_dated``.
    """
    changes = changes.where(up_to("evt_block_time", as_of))
    if must_be_dated:
        changes = dated(changes, "a delegation")
    latest = latest_per_key(changes, ["chain", "delegator"], order)
    return latest.select(
        "chain",
        "delegator",
        "to_delegate",
        "evt_block_time",
        elapsed_days("evt_block_time", as_of).alias("days_delegated"),
        F.date_format("evt_block_time", SECOND if with_time else DAY).alias("delegate_date"),
    )


def delegators_per_delegate(changes: DataFrame) -> DataFrame:
    """Current delegators of each delegate over the events of one chain: delegate, delegators."""
    latest = latest_per_key(changes, ["delegator"], LOG_ORDER)
    return latest.groupBy(F.col("to_delegate").alias("delegate")).agg(
        F.count(F.lit(1)).alias("delegators")
    )


def voting_power_snapshot(
    votes: DataFrame,
    decimals: int = 18,
    as_of: str | datetime | None = None,
    lookback: str = "1 day",
) -> DataFrame:
    """Voting power per delegate after its last event, or its last event before ``as_of - lookback``."""
    if as_of is not None:
        votes = votes.where(F.col("evt_block_time") < before(as_of, lookback))
    latest = latest_per_key(votes, ["delegate"], LOG_ORDER, ties="all")
    return latest.select(
        "delegate",
        "evt_block_number",
        "evt_index",
        "evt_block_time",
        to_tokens("new_votes", decimals).alias("dt_voting_power"),
        (to_tokens("new_votes", decimals) - to_tokens("previous_votes", decimals)).alias(
            "amt_delegated"
        ),
    )


def voting_power_change(
    votes: DataFrame, as_of: str | datetime, lookback: str, must_be_dated: bool = False
) -> DataFrame:
    """Base units at ``as_of`` (``units``) and before the lookback (``prev_units``, 0 if none) per delegate.

    Events after ``as_of`` don't count; those without a time do, or are refused if they
    ``must_be_dated``. One pass over the events: each delegate is first cut to its last event on either side of
    ``as_of - lookback``, whatever the number of events, and those two rows then meet.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    votes = votes.where(up_to("evt_block_time", as_of))
    if must_be_dated:
        votes = dated(votes, "a vote")
    earlier = F.coalesce(F.col("evt_block_time") < before(as_of, lookback), F.lit(False))
    sides = votes.select(
        "delegate", F.col("new_votes").alias("units"), *LOG_ORDER, earlier.alias("earlier")
    )
    ends = latest_per_key(sides, ["delegate", "earlier"], LOG_ORDER)
    both = Window.partitionBy("delegate")
    last = both.orderBy(*[F.col(c).desc_nulls_last() for c in LOG_ORDER])
    then = F.max(F.when(F.col("earlier"), F.col("units"))).over(both)
    return (
        ends.withColumn("prev_units", F.coalesce(then, zero))
        .withColumn("_place", F.row_number().over(last))
        .where("_place = 1")
        .select("delegate", "units", "prev_units")
    )

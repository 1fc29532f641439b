"""State at any moment, from kept history instead of all events.

``delegation_intervals`` and ``vote_intervals`` give each event the time span in which it is the last
one of its address, so the state at a moment is a range filter over one kept table.
``balance_history`` keeps each address's cumulative balance at the ends of the periods in which it
moved, so a balance needs the kept row and the transfers since the last period's end.

The kept tables grow with the events, not with the moments asked for. Write them with ``keep``, which
clusters them by the end of their spans: a recent moment then reads the row groups still open.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakeline.functions.addresses import to_text
from stakeline.functions.amounts import UNITS, to_tokens
from stakeline.functions.times import DAY, SECOND, before, elapsed_days, moment
from stakeline.operators.snapshots import EVENT_ORDER, LOG_ORDER
from stakeline.scale import BROADCAST_ROWS, Sized, aggregate_for

# Events of one address are put in order span by span: so many days, or so many blocks.
SPAN_DAYS, SPAN_BLOCKS = 30, 200_000
# Stand for "ahead of" and "after" all times.
BEGIN, END = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def _span(df: DataFrame, column: str, length: int) -> Column:
    """Which stretch of the order an event lies in; events without the column come first."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        place = F.unix_date(F.col(column).cast("date")).cast("long")
    else:
        place = F.col(column).cast("long")
    return F.coalesce(F.floor(place / length), F.lit(-(1 << 62)))


def _intervals(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], undated: str, ties: str, span: int
) -> DataFrame:
    """Events with ``valid_from`` (their time) and ``valid_to``: the first time of any later event of the key.

    An event whose span would be empty is never the last one and is left out. NULL times count as
    ``undated``. A key's events are ordered within stretches of ``span``, and the stretches by their
    earliest times, so that no task has to order all events of a busy key.
    """
    time = F.coalesce("evt_block_time", F.lit(undated).cast("timestamp_ntz"))
    rows = events.withColumn("_at", time).withColumn("_span", _span(events, order[0], span))
    newest = [F.col(c).desc_nulls_last() for c in order]
    within = Window.partitionBy(*keys, "_span").orderBy(*newest)
    if ties == "first":
        rows = rows.withColumn("_near", F.min("_at").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    else:
        rows = rows.withColumn("_place", F.dense_rank().over(within))
        above = Window.partitionBy(*keys, "_span").orderBy("_place").rangeBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_near", F.min("_at").over(above)).drop("_place")
    later = Window.partitionBy(*keys).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        events.withColumn("_at", time).withColumn("_span", _span(events, order[0], span))
        .groupBy(*keys, "_span").agg(F.min("_at").alias("_first"))
        .withColumn("_far", F.min("_first").over(later))
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_span").alias("_of"), "_far")
    )
    same = F.col("_span") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(spans, same).withColumn("valid_to", F.least("_near", "_far"))
    kept = joined.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_at")))
    columns = [c for c in events.columns if c != "evt_block_time"]
    return kept.select(*columns, F.col("evt_block_time").alias("valid_from"), "valid_to")


def delegation_intervals(
    changes: DataFrame, order: Sequence[str] = EVENT_ORDER, span: int | None = None
) -> DataFrame:
    """Delegations with the time in which each is the current one of its (chain, delegator).

    ``order`` says which event is the later one. An event without a time counts from the beginning,
    as it does in ``current_delegations``.
    """
    span = span or (SPAN_DAYS if order[0] == "evt_block_time" else SPAN_BLOCKS)
    rows = _intervals(changes, ["chain", "delegator"], order, BEGIN, "first", span)
    return rows.select("chain", "delegator", "to_delegate", "valid_from", "valid_to")


def delegations_at(intervals: DataFrame, as_of: str | datetime, with_time: bool = True) -> DataFrame:
    """``current_delegations`` at ``as_of`` from kept intervals: one filtered scan."""
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= moment(as_of))
    lasting = F.col("valid_to").isNull() | (F.col("valid_to") > moment(as_of))
    return intervals.where(begun & lasting).select(
        "chain",
        "delegator",
        "to_delegate",
        F.col("valid_from").alias("evt_block_time"),
        elapsed_days("valid_from", as_of).alias("days_delegated"),
        F.date_format("valid_from", SECOND if with_time else DAY).alias("delegate_date"),
    )


def vote_intervals(votes: DataFrame, span: int = SPAN_BLOCKS) -> DataFrame:
    """Vote-power events with the time in which each is a last one of its delegate; ties are all kept.

    An event without a time belongs to the present only, as in ``voting_power_snapshot``.
    """
    rows = _intervals(votes, ["delegate"], LOG_ORDER, END, "all", span)
    return rows.select("delegate", "new_votes", "previous_votes", *LOG_ORDER, "valid_from", "valid_to")


def voting_power_at(
    intervals: DataFrame, decimals: int = 18, as_of: str | datetime | None = None, lookback: str = "1 day"
) -> DataFrame:
    """``voting_power_snapshot`` from kept intervals: power now, or just before ``as_of - lookback``."""
    if as_of is None:
        rows = intervals.where(F.col("valid_to").isNull())
    else:
        ends = before(as_of, lookback)
        rows = intervals.where(
            (F.col("valid_from") < ends) & (F.col("valid_to").isNull() | (F.col("valid_to") >= ends))
        )
    return rows.select(
        "delegate",
        "evt_block_number",
        "evt_index",
        F.col("valid_from").alias("evt_block_time"),
        to_tokens("new_votes", decimals).alias("dt_voting_power"),
        (to_tokens("new_votes", decimals) - to_tokens("previous_votes", decimals)).alias("amt_delegated"),
    )


def period_start(time: Column, period: str) -> Column:
    """First moment of the period (DAY, WEEK, MONTH, QUARTER or YEAR) that ``time`` lies in."""
    day = time.cast("date")
    return (day if period.upper() == "DAY" else F.trunc(day, period)).cast("timestamp_ntz")


def legs_of(transfers: DataFrame) -> DataFrame:
    """Both legs of every transfer, with the time."""
    return transfers.selectExpr(
        "chain", "evt_block_time", "stack(2, `from`, -value, `to`, value) AS (delegator, units)"
    )


def balance_history(transfers: DataFrame, period: str = "MONTH") -> DataFrame:
    """Balances of all addresses at the ends of periods: chain, delegator, units, legs, valid_from, valid_to.

    One row per address and period in which it moved, valid from that period's end to the end of the
    next such period. ``units`` is the exact sum of all legs so far and NULL if there is none with an
    amount or the sum has over 38 digits; ``legs`` counts those with an amount. Transfers without a
    time count from the beginning. Map tasks add up the legs of an address and period before they
    are shuffled, so an address has as many rows to be ordered as it has periods.
    """
    length = "3 MONTH" if period.upper() == "QUARTER" else f"1 {period}"
    end = period_start(F.col("evt_block_time"), period) + F.expr(f"INTERVAL {length}")
    moved = legs_of(transfers).groupBy("chain", "delegator", end.alias("valid_from"))
    sums = moved.agg(F.try_sum("units").alias("units"), F.count("units").alias("legs"))
    by = Window.partitionBy("chain", "delegator").orderBy(F.col("valid_from").asc_nulls_first())
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Within a period a sum may be too large already; the sums after it are then unknown too.
    broken = F.max(F.col("units").isNull() & (F.col("legs") > 0)).over(so_far)
    return sums.select(
        "chain",
        "delegator",
        F.when(~broken, F.try_sum("units").over(so_far)).cast(UNITS).alias("units"),
        F.sum("legs").over(so_far).alias("legs"),
        "valid_from",
        F.lead("valid_from").over(by).alias("valid_to"),
    )


def ledger_at(
    history: DataFrame,
    transfers: DataFrame,
    holders: Sized,
    as_of: str | datetime,
    decimals: int = 18,
    period: str = "MONTH",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``ledger_balances`` over the transfers up to ``as_of``, from kept balances and one period of transfers.

    ``history`` is ``balance_history`` of the same transfers with the same ``period``, kept at any
    time after the last full period ahead of ``as_of``.
    """
    start = period_start(moment(as_of), period)
    opening = history.where(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= start))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > start))
    ).select("chain", "delegator", "units", "legs")
    time = F.col("evt_block_time")
    later = legs_of(transfers.where((time >= start) & (time <= moment(as_of)))).select(
        "chain", "delegator", "units", F.col("units").isNotNull().cast("long").alias("legs")
    )
    summed = aggregate_for(
        opening.unionByName(later),
        holders,
        ["chain", "delegator"],
        F.try_sum("units").alias("units"),
        F.sum("legs").alias("_legs"),
        F.max(F.col("units").isNull() & (F.col("legs") > 0)).alias("_broken"),
        broadcast_rows=broadcast_rows,
    )
    overflow = F.raise_error(F.concat(F.lit("balance over 38 digits: "), to_text("delegator"))).cast(UNITS)
    lost = F.col("_broken") | (F.col("units").isNull() & (F.col("_legs") > 0))
    units = F.when(lost, overflow).otherwise(F.col("units"))
    return (
        summed.withColumn("units", units).drop("_legs", "_broken").withColumn("w_delegated", to_tokens("units", decimals))
    )


def keep(history: DataFrame, path: str) -> DataFrame:
    """Write intervals or balances to a new folder ``path``, clustered by the end of their spans, and read them.

    Open spans come last, together, so a scan for a recent moment skips the row groups that closed
    before it.
    """
    spark: SparkSession = history.sparkSession
    ends = F.coalesce("valid_to", F.lit(END).cast("timestamp_ntz"))
    order = ["_end", *(c for c in ("chain", "delegator", "delegate") if c in history.columns)]
    rows = history.withColumn("_end", ends)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_end").write.parquet(path)
    return spark.read.schema(history.schema).parquet(path)

"""Ranked lists of delegators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeline.config import k_label
from stakeline.functions.addresses import to_text
from stakeline.functions.amounts import UNITS, share, to_tokens
from stakeline.operators import selection
from stakeline.scale import (
    BROADCAST_ROWS,
    WINDOW_ROWS,
    Sized,
    keep,
    left_lookup,
    pin,
    rank_rows,
    small,
    with_row,
)


def _order() -> list[Column]:
    # Amount and days alone tie, so the addresses and names complete the order.
    return [
        F.col("units").desc_nulls_last(),
        F.col("days_delegated").desc_nulls_last(),
        F.col("delegator").asc_nulls_last(),
        F.col("delegate_name").asc_nulls_last(),
    ]


def _book(names: DataFrame) -> DataFrame:
    return names.select(
        F.col("address").alias("to_delegate"),
        F.col("address").alias("delegate_address"),
        F.coalesce("name", to_text("address")).alias("delegate_name"),
    )


def _above_dust(df: DataFrame, dust: float) -> DataFrame:
    return df.where(
        (F.col("w_delegated") > dust) & (F.col("pct_of_delegated") > dust) & (F.col("days_delegated") > 0)
    )


def delegator_leaderboard(
    holdings: Sized,
    names: DataFrame,
    decimals: int = 18,
    dust: float = 1e-12,
    broadcast_rows: int = BROADCAST_ROWS,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Delegators of one chain by balance, with their share and the total.

    Equal rows from a repeated address-book entry show once, and ``total_w_delegated`` counts them
    once, yet the share is taken of the total with repeats. Making the book distinct with a repeat
    count gives both without a DISTINCT over the delegators. Ranks and totals precede the filter.
    """
    book = (
        _book(names)
        .groupBy("to_delegate", "delegate_address", "delegate_name")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    listed = left_lookup(holdings, book, "to_delegate", broadcast_rows)
    copies = F.coalesce("copies", F.lit(1)).cast("decimal(10,0)")
    totals = listed.df.agg(
        F.sum((F.col("units") * copies).cast(UNITS)).alias("repeated_units"),
        F.sum("units").alias("distinct_units"),
    )
    ranked = with_row(rank_rows(listed, [], _order(), window_rows), totals).select(
        "rank",
        "chain",
        "delegator",
        "units",
        to_tokens("units", decimals).alias("w_delegated"),
        share("units", "repeated_units").alias("pct_of_delegated"),
        "days_delegated",
        "delegate_date",
        "delegate_name",
        "delegate_address",
        to_tokens("distinct_units", decimals).alias("total_w_delegated"),
    )
    return _above_dust(ranked, dust)


def delegator_leaderboard_multi(
    holdings: Sized,
    names: DataFrame,
    decimals: int = 18,
    dust: float = 1e-12,
    broadcast_rows: int = BROADCAST_ROWS,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Delegators of all chains, ranked within their chain, with share and total of the chain.

    A repeated address-book entry repeats the row, takes a rank of its own and counts in the
    chain's total. Ranks, shares and totals precede the filter.
    """
    ranked = ranked_delegators(holdings, names, broadcast_rows, window_rows)
    return with_shares(ranked, chain_units(ranked), decimals, dust)


def ranked_delegators(
    holdings: Sized,
    names: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Delegators of all chains with the names of their delegates, ranked within their chain; kept."""
    listed = left_lookup(holdings, _book(names), "to_delegate", broadcast_rows)
    return keep(rank_rows(listed, ["chain"], _order(), window_rows), "ranked")


def listed_delegators(holdings: Sized, names: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same without ranks, not kept."""
    return left_lookup(holdings, _book(names), "to_delegate", broadcast_rows).df


def chain_units(rows: DataFrame) -> DataFrame:
    """Total of each chain; kept, one row per chain."""
    return small(pin(rows.groupBy("chain").agg(F.sum("units").alias("chain_units")), "chain-units"))


def thresholds(
    holdings: Sized, names: DataFrame, ks: Sequence[int], decimals: int = 18, dust: float = 1e-12,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``metrics.rank_thresholds`` of ``delegator_leaderboard_multi`` without ranking anybody.

    Amount and days of the row at rank k are found by counting (see ``selection``); rows that tie in
    both have the same threshold.
    """
    listed = listed_delegators(holdings, names, broadcast_rows)
    totals = keep(listed.groupBy("chain").agg(F.sum("units").alias("chain_units")), "chain-units")
    at = selection.values_at_ranks(listed, ks, "chain", ["units", "days_delegated"])
    at = at.join(totals.withColumnRenamed("chain", "_chain"), F.col("chain").eqNullSafe(F.col("_chain")), "left")
    kept = _above_dust(
        at.select(
            "chain", "k", "days_delegated", to_tokens("units", decimals).alias("w_delegated"),
            share("units", "chain_units").alias("pct_of_delegated"),
        ),
        dust,
    )
    marks = kept.groupBy(F.col("chain").alias("_chain")).agg(
        *[F.max(F.when(F.col("k") == k, F.col("w_delegated"))).alias(f"tokens_for_top_{k_label(k)}") for k in ks]
    )
    chains = with_shares(listed, totals, decimals, dust).select("chain").distinct()
    return chains.join(marks, F.col("chain").eqNullSafe(F.col("_chain")), "left").drop("_chain")


def with_shares(rows: DataFrame, totals: DataFrame, decimals: int = 18, dust: float = 1e-12) -> DataFrame:
    """Amounts, shares and totals of listed or ranked delegators, those above the dust only."""
    totals = totals.withColumnRenamed("chain", "_chain")
    joined = rows.join(totals, F.col("chain").eqNullSafe(F.col("_chain")), "left")
    shares = joined.select(
        *(["rank"] if "rank" in rows.columns else []),
        "chain",
        "delegator",
        "units",
        to_tokens("units", decimals).alias("w_delegated"),
        share("units", "chain_units").alias("pct_of_delegated"),
        "days_delegated",
        "delegate_date",
        "delegate_name",
        "delegate_address",
        to_tokens("chain_units", decimals).alias("total_w_delegated_blockchain"),
    )
    return _above_dust(shares, dust)


def global_rank(leaderboard: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Re-rank a filtered multi-chain leaderboard across chains; the leaderboard is kept first."""
    return rank_rows(pin(leaderboard.drop("rank"), "board"), [], [*_order(), F.col("chain")], window_rows)

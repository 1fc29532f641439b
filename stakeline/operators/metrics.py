"""Figures derived from balances, delegations and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeline.config import k_label
from stakeline.functions.amounts import to_tokens


def rank_thresholds(leaderboard: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Tokens held at rank k, per chain; NULL if that rank does not exist or was filtered away."""
    # Only rows at those ranks carry an amount; where the ranks are stored, the scan skips the rest.
    wanted = leaderboard.where(F.col("rank").isin(*ks)).select("chain", "rank", "w_delegated")
    marks = wanted.groupBy("chain").agg(
        *[F.max(F.when(F.col("rank") == k, F.col("w_delegated"))).alias(f"tokens_for_top_{k_label(k)}") for k in ks]
    )
    chains = leaderboard.select("chain").distinct()
    names = [f"tokens_for_top_{k_label(k)}" for k in ks]
    marks = marks.withColumnRenamed("chain", "_chain")
    return chains.join(marks, F.col("chain").eqNullSafe(F.col("_chain")), "left").select("chain", *names)


def rank_thresholds_wide(
    leaderboard: DataFrame, ks: Sequence[int], prefixes: dict[str, str]
) -> DataFrame:
    """The same as one row, a column per chain and k: ``<prefix>_top_<k>``."""
    wanted = leaderboard.where(F.col("rank").isin(*ks))
    return wanted.agg(
        *[
            F.max(F.when((F.col("chain") == chain) & (F.col("rank") == k), F.col("w_delegated"))).alias(
                f"{prefix}_top_{k_label(k)}"
            )
            for chain, prefix in prefixes.items()
            for k in ks
        ]
    )


def wide_thresholds(marks: DataFrame, ks: Sequence[int], prefixes: dict[str, str]) -> DataFrame:
    """``rank_thresholds`` turned into one row, as ``rank_thresholds_wide`` gives it."""
    return marks.agg(
        *[
            F.max(F.when(F.col("chain") == chain, F.col(f"tokens_for_top_{k_label(k)}"))).alias(f"{prefix}_top_{k_label(k)}")
            for chain, prefix in prefixes.items()
            for k in ks
        ]
    )


def chain_totals(
    balances: DataFrame, chains: Sequence[str], decimals: int = 18, strict: bool = False
) -> DataFrame:
    """One row: ``total_w_delegated_<chain>`` (NULL for an empty chain) and ``total_w_delegated_all``.

    The grand total adds whatever rows exist; with ``strict`` it adds the chain totals, so one
    empty chain makes it NULL.
    """
    totals = {
        f"total_w_delegated_{c.lower()}": F.sum(F.when(F.col("chain") == c, F.col("units"))) for c in chains
    }
    grand = reduce(Column.__add__, totals.values()) if strict else F.sum("units")
    return balances.agg(
        *[to_tokens(total, decimals).alias(name) for name, total in totals.items()],
        to_tokens(grand, decimals).alias("total_w_delegated_all"),
    )


def unique_delegators(df: DataFrame) -> DataFrame:
    """Delegators per chain of a table with one row per (chain, delegator).

    Over current delegations this includes delegators without transfers; over balances it does not.
    """
    return df.groupBy("chain").agg(F.count("delegator").alias("unique_delegators"))


def distinct_stakers(leaderboard: DataFrame) -> DataFrame:
    """Distinct addresses across chains, one row."""
    return leaderboard.agg(F.count_distinct("delegator").alias("num_of_stakers"))


def range_label(edges: Sequence[int], last: int, i: int) -> str:
    """Label of bucket ``i``; the last bucket is labelled as if closed at ``last``."""
    if i == 0:
        return f"<{k_label(edges[0])}"
    upper = edges[i] if i < len(edges) else last
    return f"{k_label(edges[i - 1])}-<{k_label(upper)}"


def holding_histogram(leaderboard: DataFrame, edges: Sequence[int], last: int) -> DataFrame:
    """Rows per holding size, in the order of the sizes; empty buckets are absent."""
    bucket = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        bucket = F.when(F.col("w_delegated") < edge, i).otherwise(bucket)
    labels = F.array(*[F.lit(range_label(edges, last, i)) for i in range(len(edges) + 1)])
    return (
        leaderboard.groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("num_of_stakers"))
        .orderBy("bucket")
        .select(F.get(labels, F.col("bucket")).alias("w_delegated_range"), "num_of_stakers")
    )

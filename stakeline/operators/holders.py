"""Token holders from balance snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeline.functions.addresses import literal
from stakeline.functions.amounts import UNITS, to_tokens
from stakeline.operators import selection
from stakeline.operators.snapshots import latest_per_key
from stakeline.scale import WINDOW_ROWS, Sized, pin, small, top_rows, with_row


def latest_holdings(balances: DataFrame, token: Column | str | bytes) -> DataFrame:
    """Last non-zero balance of the token, given by its address, per (chain, address).

    Zero balances go first, so an emptied wallet keeps its last non-zero balance.
    """
    held = balances.where((F.col("token_address") == literal(token)) & (F.col("balance") != 0))
    return latest_per_key(held, ["chain", "address"], ["block_time", "units"]).select(
        "address", "balance", "units", "chain"
    )


def _order() -> list[Column]:
    return [F.col("units").desc_nulls_last(), F.col("address"), F.col("chain")]


def balance_at_ranks(holders: Sized, ks: Sequence[int], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One row: balance of the k-th largest holder across chains, NULL beyond the last holder.

    More holders than ``window_rows`` are not sorted: the units at each rank are found by counting,
    and only where holders of equal units differ in their balance are these put in order.
    """
    if holders.rows <= window_rows:
        rows = Sized(holders.df.select("units", "balance", "address", "chain"), holders.rows)
        top = top_rows(rows, _order(), max(ks), window_rows)
        return top.agg(*[F.max(F.when(F.col("rank") == k, F.col("balance"))).alias(f"top_{k}_balance") for k in ks])
    at = selection.places(holders.df, "units", {str(k): (F.lit(True), k) for k in ks})
    held = {k: F.col("units").eqNullSafe(F.lit(at[str(k)].value).cast(UNITS)) for k in ks}
    ends = holders.df.agg(
        *[f(F.when(held[k], F.col("balance"))).alias(f"{name}_{k}") for k in ks for name, f in (("low", F.min), ("high", F.max))],
        *[F.count_if(held[k] & F.col("balance").isNull()).alias(f"none_{k}") for k in ks],
        F.count("units").alias("known"),
    ).first()
    found = {}
    for k in ks:
        if at[str(k)].value is None and k > holders.rows:
            found[k] = None
        elif ends[f"low_{k}"] == ends[f"high_{k}"] and not ends[f"none_{k}"]:
            found[k] = ends[f"high_{k}"]
        else:
            above = ends["known"] if at[str(k)].value is None else at[str(k)].above
            tied = Sized(holders.df.where(held[k]), at[str(k)].ties or holders.rows)
            row = top_rows(tied, _order(), k - above, window_rows).where(F.col("rank") == k - above).first()
            found[k] = row and row["balance"]
    values = [F.lit(found[k]).cast("double").alias(f"top_{k}_balance") for k in ks]
    return holders.df.sparkSession.range(1).select(*values)


def holder_snapshot(holders: Sized, ks: Sequence[int], decimals: int = 18) -> DataFrame:
    """Holders by balance with grand total, chain total, rank thresholds and holder count.

    Totals and the count come from one kept aggregate with a row per chain.
    """
    figures = pin(
        holders.df.groupBy("chain").agg(F.sum("units").alias("chain_units"), F.count("address").alias("holders")),
        "holder-totals",
    )
    totals = figures.df.agg(F.sum("chain_units").alias("all_units"), F.sum("holders").alias("holders"))
    per_chain = small(Sized(figures.df.select(F.col("chain").alias("_chain"), "chain_units"), figures.rows))
    out = holders.df.orderBy(*_order()).join(per_chain, F.col("chain").eqNullSafe(F.col("_chain")), "left")
    return with_row(with_row(out, totals), balance_at_ranks(holders, ks)).select(
        "address",
        "balance",
        F.col("chain").alias("blockchain"),
        to_tokens("all_units", decimals).alias("total_balance"),
        to_tokens("chain_units", decimals).alias("sep_balance"),
        *[f"top_{k}_balance" for k in ks],
        F.col("holders").alias("num_of_stakers"),
    )

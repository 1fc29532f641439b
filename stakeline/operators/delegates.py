"""Delegates by voting power: top list, ranking, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeline.functions.addresses import to_text
from stakeline.functions.amounts import change_ratio, share, to_tokens
from stakeline.functions.links import delegate_anchor, html_link
from stakeline.scale import WINDOW_ROWS, Sized, pin, top_rows, with_row

OTHER = "Other"


def top_delegates(power: Sized, n: int, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``delegate, units`` of those in the first ``n`` now or before; kept, at most 2n rows."""
    now, then, name = F.col("units").desc(), F.col("prev_units").desc(), F.col("delegate")
    leaders = top_rows(power, [now, then, name], n, window_rows)
    former = top_rows(power, [then, now, name], n, window_rows)
    both = leaders.select("delegate", "units").union(former.select("delegate", "units"))
    return pin(both.distinct(), "top").df


def top_n_with_other(
    power: DataFrame, top: DataFrame, delegators: DataFrame, labels: DataFrame, decimals: int = 18
) -> DataFrame:
    """One row per delegate in ``top`` (at most 2n rows) and one for all the rest.

    ``labels`` has at most one row per delegate in ``top``. A delegate nobody delegates to counts
    one delegator. Among the rest, delegates with the same power now and before add that power
    once, while all their delegators count.
    """
    total = power.agg(F.sum("units").alias("total_units"))
    in_top = F.col("_top").isNotNull()
    by_power = ["units", "prev_units"]
    groups = (
        power.join(F.broadcast(top.select("delegate", F.lit(True).alias("_top"))), "delegate", "left")
        .join(delegators, "delegate", "left")
        .join(F.broadcast(labels.withColumnRenamed("address", "delegate")), "delegate", "left")
        .groupBy(
            F.when(in_top, to_text("delegate")).otherwise(OTHER).alias("delegate"),
            F.when(in_top, F.col("name")).alias("name"),
            F.when(in_top, F.col("ens")).alias("ens"),
            *by_power,
        )
        .agg(F.sum(F.coalesce("delegators", F.lit(1))).alias("num_delegators"))
    )
    merged = groups.groupBy("delegate", "name", "ens").agg(
        *[F.sum(c).alias(c) for c in [*by_power, "num_delegators"]]
    )
    return with_row(merged, total).select(
        "delegate",
        "name",
        "ens",
        "units",
        to_tokens("units", decimals).alias("dt_voting_power"),
        share("units", "total_units").alias("pct_voting_power"),
        "num_delegators",
        to_tokens(F.col("units") - F.col("prev_units"), decimals).alias("vp_change_30d"),
        to_tokens("prev_units", decimals).alias("prev_voting_power"),
        "total_units",
    )


def delegate_ranking(
    merged: DataFrame, n: int, vote_page: str, breakdown_page: str, caption: str
) -> DataFrame:
    """Dense rank by power, links, change against the earlier power and share of delegators.

    The input has at most 2n + 1 rows, so its windows run in one task. The collapsed row always
    ranks n + 1. ``vp_change_30d`` spans the lookback of the snapshot.
    """
    other = F.col("delegate") == OTHER
    by_power = Window.orderBy(F.when(other, 0).otherwise(F.col("units")).desc())
    whole = Window.partitionBy()
    return merged.select(
        "delegate",
        F.when(other, n + 1).otherwise(F.dense_rank().over(by_power)).cast("long").alias("delegate_rank"),
        F.when(other, F.col("delegate"))
        .otherwise(delegate_anchor(vote_page, F.col("delegate"), F.col("name"), F.col("ens")))
        .alias("delegate_name"),
        html_link(F.concat(F.lit(breakdown_page), "delegate"), F.lit(caption)).alias("delegator_link"),
        F.lit("|").alias("col1"),
        "dt_voting_power",
        "pct_voting_power",
        F.lit("|").alias("col2"),
        "vp_change_30d",
        change_ratio("vp_change_30d", "prev_voting_power").alias("pct_vp_change_30d"),
        F.lit("|").alias("col3"),
        "num_delegators",
        share("num_delegators", F.sum("num_delegators").over(whole)).alias("pct_delegators"),
        F.coalesce("name", "ens", "delegate").alias("delegate_name_raw"),
        F.col("delegate").alias("delegate_address"),
        "units",
        "total_units",
    )


def one_per_delegate(ranking: DataFrame) -> DataFrame:
    """Keep one row per delegate (the last by name), marked ``rn`` = 1."""
    window = Window.partitionBy("delegate").orderBy(F.col("delegate_name").desc_nulls_last())
    return ranking.withColumn("rn", F.row_number().over(window).cast("long")).where("rn = 1")


def concentration(
    ranking: DataFrame, majority: float = 0.5, quorum: float = 21_000_000, decimals: int = 18
) -> DataFrame:
    """Running power in rank order and how many delegates make a majority and a quorum.

    Tied ranks share one running value. Never reaching a mark gives 1e18. Sums are of base units,
    the input is a ranking of at most 2n + 1 rows.
    """
    running = Window.orderBy("delegate_rank").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy()
    summed = ranking.withColumn("_running", F.sum("units").over(running)).select(
        *[c for c in ranking.columns if c not in ("units", "total_units")],
        share("_running", "total_units").alias("running_pct_voting_power"),
        to_tokens("_running", decimals).alias("running_dt_voting_power"),
        "units",
    )

    def first_rank(reached: Column) -> Column:
        rank = F.col("delegate_rank").cast("double")
        return F.min(F.when(reached, rank).otherwise(1e18)).over(whole)

    return summed.select(
        *[c for c in summed.columns if c != "units"],
        to_tokens(F.sum("units").over(whole), decimals).alias("total_voting_power"),
        first_rank(F.col("running_pct_voting_power") >= majority).alias("num_delegates_to_majority"),
        first_rank(F.col("running_dt_voting_power") >= quorum).alias("num_delegates_to_quorum"),
    )

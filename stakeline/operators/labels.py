"""Names for delegates from the address book, ENS and category labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeline.functions.amounts import blank_to_null
from stakeline.scale import BROADCAST_ROWS, Sized, aggregate_for


def _joined(col: str) -> Column:
    """Distinct non-null values, sorted and comma-separated; they make one text, so they meet in one task."""
    return F.concat_ws(",", F.array_sort(F.collect_set(col))).alias(col)


def resolve_labels(
    delegates: Sized,
    names: DataFrame,
    ens: DataFrame,
    labels: DataFrame,
    category: str = "institution",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``address``, ``name`` and ``ens`` of ``delegates``, a table of distinct addresses.

    ENS and category labels count only for addresses missing from the address book. An empty name
    falls back to the label; empty texts become NULL. Each lookup is reduced to one row per
    address first, so repeats in one never multiply those in another.
    """
    def per_address(df: DataFrame, *cols: str) -> DataFrame:
        # Repeats of a name go ahead of that, wherever they lie.
        df = df.select("address", *cols).distinct()
        return aggregate_for(
            df, delegates, ["address"], *[_joined(c) for c in cols], broadcast_rows=broadcast_rows
        )

    listed = F.lit(True).alias("listed")
    book = per_address(names, "name", "ens").select("*", listed)
    domains = per_address(ens.where("name IS NOT NULL"), "name").select(
        "address", F.col("name").alias("domain")
    )
    tags = per_address(
        labels.where((F.col("category") == category) & F.col("name").isNotNull()), "name"
    ).select("address", F.col("name").alias("tag"))
    in_book = F.col("listed").isNotNull()
    return (
        delegates.df.select("address")
        .join(book, "address", "left")
        .join(domains, "address", "left")
        .join(tags, "address", "left")
        .select(
            "address",
            F.coalesce(
                blank_to_null("name"), F.when(~in_book, blank_to_null("tag"))
            ).alias("name"),
            blank_to_null(F.when(in_book, F.col("ens")).otherwise(F.col("domain"))).alias("ens"),
        )
    )

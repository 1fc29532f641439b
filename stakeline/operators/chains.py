"""Uniting tables that are kept per chain."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_chains(frames: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL of one frame per chain, columns matched by name, tagged with ``chain``.

    A later filter on ``chain`` prunes the other branches at planning time.
    """
    tagged = [df.select(F.lit(chain).alias("chain"), "*") for chain, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)

"""Readers for the decoded event, balance and label tables.

Each reader takes a DataFrame, a table or view name, a folder path, or a ``{chain: one of these}``
mapping for tables kept per chain. It selects only the columns the operators use, under one set of
names and types: BINARY addresses, DECIMAL(38,0) base units, TIMESTAMP_NTZ in UTC. A malformed
address stops the reading of events; in the name and label tables it merely matches nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakeline.functions.addresses import from_text
from stakeline.functions.amounts import UNITS, to_units
from stakeline.functions.times import utc
from stakeline.operators.chains import union_chains

Source = DataFrame | str | Mapping[str, "DataFrame | str"]


def load(spark: SparkSession, source: DataFrame | str, fmt: str = "parquet") -> DataFrame:
    """A DataFrame as it is, a path (anything with a slash) by format, any other text as a table."""
    if isinstance(source, DataFrame):
        return source
    if "/" in source:
        return spark.read.format(fmt).load(source)
    return spark.table(source)


def _find(df: DataFrame, name: str) -> T.StructField | None:
    """Field called ``name`` in snake, camel or any other case."""
    plain = name.replace("_", "").lower()
    return next((f for f in df.schema.fields if f.name.replace("_", "").lower() == plain), None)


def _column(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    found = _find(df, name)
    if found is None:
        raise ValueError(f"no column {name} in {df.columns}")
    return F.col(f"`{found.name}`"), found.dataType


def _address(df: DataFrame, name: str, strict: bool = True) -> Column:
    col, kind = _column(df, name)
    return (col if isinstance(kind, T.BinaryType) else from_text(col, strict)).alias(name)


def _units(df: DataFrame, name: str) -> Column:
    col, kind = _column(df, name)
    exact = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
    return (col.cast(UNITS) if exact else to_units(col)).alias(name)


def _time(df: DataFrame, name: str) -> Column:
    col, kind = _column(df, name)
    return (col if isinstance(kind, T.TimestampNTZType) else utc(col.cast("timestamp"))).alias(name)


def _as(df: DataFrame, name: str, kind: str) -> Column:
    return _column(df, name)[0].cast(kind).alias(name)


def _per_chain(spark: SparkSession, source: Source, columns, fmt: str) -> DataFrame:
    """Read one table that has a ``chain`` column, or tag and unite one table per chain."""
    if isinstance(source, Mapping):
        frames = {chain: load(spark, one, fmt) for chain, one in source.items()}
        return union_chains({chain: df.select(*columns(df)) for chain, df in frames.items()})
    df = load(spark, source, fmt)
    return df.select(_as(df, "chain", "string"), *columns(df))


def delegate_changed(spark: SparkSession, source: Source, fmt: str = "parquet") -> DataFrame:
    """Delegation events: chain, delegator, to_delegate, evt_block_number, evt_index, evt_block_time."""
    return _per_chain(
        spark,
        source,
        lambda df: [
            _address(df, "delegator"),
            _address(df, "to_delegate"),
            _as(df, "evt_block_number", "bigint"),
            _as(df, "evt_index", "bigint"),
            _time(df, "evt_block_time"),
        ],
        fmt,
    )


def transfers(spark: SparkSession, source: Source, fmt: str = "parquet") -> DataFrame:
    """Token transfers: chain, from, to, value, evt_block_time (NULL where the table has no such column)."""

    def columns(df: DataFrame) -> list[Column]:
        timed = _find(df, "evt_block_time") is not None
        time = _time(df, "evt_block_time") if timed else F.lit(None).cast("timestamp_ntz").alias("evt_block_time")
        return [_address(df, "from"), _address(df, "to"), _units(df, "value"), time]

    return _per_chain(spark, source, columns, fmt)


def votes_changed(spark: SparkSession, source: Source, fmt: str = "parquet") -> DataFrame:
    """Vote-power events: chain, delegate, new_votes, previous_votes and the event position."""
    return _per_chain(
        spark,
        source,
        lambda df: [
            _address(df, "delegate"),
            _units(df, "new_votes"),
            _units(df, "previous_votes"),
            _as(df, "evt_block_number", "bigint"),
            _as(df, "evt_index", "bigint"),
            _time(df, "evt_block_time"),
        ],
        fmt,
    )


def balances(
    spark: SparkSession, source: Source, decimals: int = 18, fmt: str = "parquet"
) -> DataFrame:
    """Balance snapshots: chain, address, token_address, balance, units, block_time.

    Tables may give the balance in tokens, in base units (``balance_raw``), or both; the missing
    one is derived.
    """

    def columns(df: DataFrame) -> list[Column]:
        scale = F.lit(float(10**decimals))
        raw = to_units(_column(df, "balance_raw")[0]) if _find(df, "balance_raw") else None
        tokens = _column(df, "balance")[0].cast("double") if _find(df, "balance") else None
        if raw is None:
            raw = to_units(F.round(tokens * scale))
        if tokens is None:
            tokens = raw.cast("double") / scale
        return [
            _address(df, "address"),
            _address(df, "token_address"),
            tokens.alias("balance"),
            raw.alias("units"),
            _time(df, "block_time"),
        ]

    return _per_chain(spark, source, columns, fmt)


def address_names(spark: SparkSession, source: DataFrame | str, fmt: str = "parquet") -> DataFrame:
    """Address book: address, name, ens (NULL where the book has no such column)."""
    df = load(spark, source, fmt)
    ens = _as(df, "ens", "string") if _find(df, "ens") else F.lit(None).cast("string").alias("ens")
    return df.select(_address(df, "address", strict=False), _as(df, "name", "string"), ens)


def ens_names(spark: SparkSession, source: DataFrame | str, fmt: str = "parquet") -> DataFrame:
    """ENS labels: address, name."""
    df = load(spark, source, fmt)
    return df.select(_address(df, "address", strict=False), _as(df, "name", "string"))


def category_labels(spark: SparkSession, source: DataFrame | str, fmt: str = "parquet") -> DataFrame:
    """Category labels: address, category, name."""
    df = load(spark, source, fmt)
    return df.select(
        _address(df, "address", strict=False), _as(df, "category", "string"), _as(df, "name", "string")
    )


@dataclass(frozen=True)
class Tables:
    """The inputs of the reports, as returned by the readers above.

    ``delegation_intervals`` and ``balance_history`` are tables that ``operators.history`` makes of the
    delegations and transfers; reports over all chains read them instead of all events where given.
    """

    delegate_changed: DataFrame | None = None
    transfers: DataFrame | None = None
    votes_changed: DataFrame | None = None
    balances: DataFrame | None = None
    address_names: DataFrame | None = None
    ens: DataFrame | None = None
    labels: DataFrame | None = None
    delegation_intervals: DataFrame | None = None
    balance_history: DataFrame | None = None

"""Event, balance and label tables as views over the TPC-H-like test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakeline.config import Config
from stakeline.functions.addresses import ZERO, address
from stakeline.functions.amounts import UNITS
from stakeline.sources import tables as src

CHAINS = ("Ethereum", "Base", "Optimism", "Arbitrum")
# Address of the token under test: that of the events of type ``signup``.
TOKEN = "0xb0ff000000000000000000000000000000007306"
CONFIG = Config(
    as_of="2001-08-01 12:00:00", decimals=4, ks=(10, 100, 1000, 2000), top_n=50, quorum=100
)
VOTES_CONFIG = Config(as_of="2024-01-31 00:00:00", decimals=4, top_n=50, quorum=100)

# Columns the views read.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_extendedprice double, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "supplier": "s_suppkey bigint, s_name string",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
}


def addr(k: Column) -> Column:
    """Number as a 20-byte address."""
    return F.unhex(F.lpad(F.hex(k.cast("long")), 40, "0"))


def chain_of(k: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CHAINS]), (k % 4).cast("int"))


def _token(kind: Column) -> Column:
    """Address text, in capitals, of the token that events of a type concern."""
    number = F.ascii(kind) * 256 + F.length(kind)
    return F.concat(F.lit("0xB0FF"), F.lpad(F.hex(number.cast("long")), 36, "0"))


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast(UNITS)


def _changes(read) -> DataFrame:
    key = F.col("o_orderkey")
    return read("orders").select(
        chain_of(key).alias("chain"),
        addr(F.col("o_custkey") + 1).alias("delegator"),
        address(ZERO).alias("fromDelegate"),
        addr(F.floor(key / 4) % 131).alias("toDelegate"),
        (F.date_diff("o_orderdate", F.lit("1995-01-01")) + 400 * (key % 3)).cast("long").alias("evt_block_number"),
        key.alias("evt_index"),
        F.col("o_orderdate").alias("evt_block_time"),
        addr(key).alias("evt_tx_hash"),
    )


def _transfers(read) -> DataFrame:
    mint = F.col("l_linenumber") != 1
    return read("lineitem").select(
        chain_of(F.col("l_orderkey")).alias("chain"),
        F.when(mint, address(ZERO)).otherwise(addr(F.col("l_suppkey") + 1)).alias("from"),
        addr(F.col("l_partkey") + 1).alias("to"),
        _whole(F.col("l_extendedprice") * 100).alias("value"),
        F.col("l_shipdate").alias("evt_block_time"),
    )


def _votes(read) -> DataFrame:
    votes = (F.floor(F.col("value") / 10) * 10000).cast(UNITS)
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    return read("events").select(
        F.lit("Ethereum").alias("chain"),
        addr(F.col("user_id")).alias("delegate"),
        votes.alias("newVotes"),
        F.coalesce(F.lag(votes).over(by_user), F.lit(0).cast(UNITS)).alias("previousVotes"),
        F.floor(F.col("event_id") / 4).alias("evt_block_number"),
        F.col("event_id").alias("evt_index"),
        F.col("ts").alias("evt_block_time"),
    )


def _balances(read) -> DataFrame:
    raw = F.when(F.col("event_id") % 10 == 0, F.lit(0).cast(UNITS)).otherwise(_whole(F.col("value") * 10000))
    return read("events").select(
        F.lower(chain_of(F.col("event_id"))).alias("chain"),
        addr(F.col("user_id")).alias("address"),
        _token(F.col("event_type")).alias("token_address"),
        raw.alias("balance_raw"),
        (raw.cast("double") / F.lit(1e4)).alias("balance"),
        F.col("ts").alias("block_time"),
    )


def _names(read) -> DataFrame:
    key, name = F.col("s_suppkey"), F.col("s_name")
    ens = F.when(key % 4 == 0, F.concat(F.lit("s"), key.cast("string"), F.lit(".eth"))).otherwise("")
    own = F.struct(F.when(key % 3 == 0, "").otherwise(name).alias("name"), ens.alias("ens"))
    alias = F.struct(F.concat(name, F.lit("-alias")).alias("name"), F.lit("").alias("ens"))
    entries = F.when(key % 5 == 0, F.array(own, alias)).otherwise(F.array(own))
    return read("supplier").select(addr(key).alias("address"), F.inline(entries))


def _ens(read) -> DataFrame:
    key = F.col("c_custkey")
    return read("customer").select(
        addr(key).alias("address"), F.when(key % 7 != 0, F.lower("c_name")).alias("name")
    )


def _labels(read) -> DataFrame:
    segment = F.col("c_mktsegment")
    return read("customer").select(
        addr(F.col("c_custkey")).alias("address"),
        F.when(segment == "BUILDING", "institution").otherwise("other").alias("category"),
        segment.alias("name"),
    )


_RAW = {
    "delegate_changed": (_changes, src.delegate_changed),
    "transfers": (_transfers, src.transfers),
    "votes_changed": (_votes, src.votes_changed),
    "balances": (_balances, lambda spark, df: src.balances(spark, df, CONFIG.decimals)),
    "address_names": (_names, src.address_names),
    "ens": (_ens, src.ens_names),
    "labels": (_labels, src.category_labels),
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view with host-style columns."""

    def read(table: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")

    return _RAW[name][0](read)


def benchmark_tables(spark: SparkSession, sf_dir: str, *names: str) -> src.Tables:
    """The named views (all by default) through the readers, as the reports take them."""
    return src.Tables(
        **{name: _RAW[name][1](spark, raw_table(spark, sf_dir, name)) for name in names or _RAW}
    )

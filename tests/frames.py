"""Small hand-made input tables."""

from datetime import datetime

from stakeline.config import Config
from stakeline.sources import tables as src

CFG = Config(as_of="2024-01-31 00:00:00", decimals=0, ks=(1, 2, 3), edges=(10, 100), last_edge_label=1000)


TOKEN = "0xB0fF00000000000000000000000000000000aBcD"


def addr(k: int) -> str:
    return f"0x{k:040x}"


def raw(k: int) -> bytearray:
    return bytearray(k.to_bytes(20, "big"))


def changes(spark, rows):
    """(chain, delegator, to_delegate, block, index, time)"""
    return src.delegate_changed(
        spark,
        spark.createDataFrame(
            [(c, addr(d), addr(t), b, i, datetime.fromisoformat(ts)) for c, d, t, b, i, ts in rows],
            "chain string, delegator string, toDelegate string, evt_block_number bigint,"
            " evt_index bigint, evt_block_time timestamp_ntz",
        ),
    )


def transfers(spark, rows):
    """(chain, from, to, value) or the same and a time"""
    early = "2000-01-01 00:00:00"
    rows = [(c, addr(f), addr(t), str(v), datetime.fromisoformat((*at, early)[0])) for c, f, t, v, *at in rows]
    return src.transfers(
        spark,
        spark.createDataFrame(
            rows, "chain string, `from` string, `to` string, value string, evt_block_time timestamp_ntz"
        ),
    )


def votes(spark, rows):
    """(delegate, new_votes, block, index, time)"""
    return src.votes_changed(
        spark,
        spark.createDataFrame(
            [
                ("Ethereum", addr(d), str(v), "0", b, i, datetime.fromisoformat(ts))
                for d, v, b, i, ts in rows
            ],
            "chain string, delegate string, newVotes string, previousVotes string,"
            " evt_block_number bigint, evt_index bigint, evt_block_time timestamp_ntz",
        ),
    )


def balances(spark, rows):
    """(chain, address, units, time)"""
    return src.balances(
        spark,
        spark.createDataFrame(
            [(c, addr(a), TOKEN, str(u), datetime.fromisoformat(ts)) for c, a, u, ts in rows],
            "chain string, address string, token_address string, balance_raw string,"
            " block_time timestamp_ntz",
        ),
        decimals=0,
    )


def names(spark, rows=()):
    """(address, name, ens)"""
    return src.address_names(
        spark,
        spark.createDataFrame(
            [(addr(a), n, e) for a, n, e in rows], "address string, name string, ens string"
        ),
    )


def ens(spark, rows=()):
    return src.ens_names(
        spark,
        spark.createDataFrame([(addr(a), n) for a, n in rows], "address string, name string"),
    )


def labels(spark, rows=()):
    return src.category_labels(
        spark,
        spark.createDataFrame(
            [(addr(a), c, n) for a, c, n in rows], "address string, category string, name string"
        ),
    )


def delegating(spark, holders, **more):
    """Tables in which each (chain, address, amount, days) holds and delegates to address 900."""
    day = {d: f"2024-01-{31 - d:02d} 00:00:00" for d in range(31)}
    return src.Tables(
        delegate_changed=changes(
            spark, [(c, a, 900, 31 - d, 0, day[d]) for c, a, _, d in holders]
        ),
        transfers=transfers(spark, [(c, 0, a, v) for c, a, v, _ in holders]),
        **{"address_names": names(spark), **more},
    )

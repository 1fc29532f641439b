"""State at a moment from kept history, and values at ranks by counting, against the plain forms."""

import random
import re
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stakeline import scale
from stakeline.operators import history, holders, leaderboard, ledger, metrics, selection, snapshots
from stakeline.plans import reports
from stakeline.scale import Sized
from stakeline.sources import layout
from stakeline.sources.benchmark import CONFIG, benchmark_tables

SF_DIR = "/root/testdata/sf0.001"
CHANGES = (
    "chain string, delegator binary, to_delegate binary, evt_block_number bigint, evt_index bigint,"
    " evt_block_time timestamp_ntz"
)
VOTES = (
    "delegate binary, new_votes decimal(38,0), previous_votes decimal(38,0), evt_block_number bigint,"
    " evt_index bigint, evt_block_time timestamp_ntz"
)
TRANSFERS = "chain string, `from` binary, `to` binary, value decimal(38,0), evt_block_time timestamp_ntz"


@pytest.fixture(autouse=True)
def whole_filters(spark):
    """Plans show filters uncut."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list:
    return sorted(map(repr, df.collect()))


def day(n: int) -> str:
    return f"2024-{1 + n // 28:02d}-{1 + n % 28:02d} 00:00:00"


def frame(spark, data, schema):
    """Rows whose last field is a time as text."""
    text = schema.replace("timestamp_ntz", "string")
    return spark.createDataFrame(data, text).withColumn("evt_block_time", F.col("evt_block_time").cast("timestamp_ntz"))


def changes(spark, dated=True):
    """Two busy keys, a key that is NULL, blocks whose order is not that of their times, undated events."""
    rng, data = random.Random(3), []
    for i in range(300):
        key = b"\x01" if i % 3 else rng.choice([b"\x02", b"\x03", None])
        time = None if not dated and i % 29 == 0 else day(rng.randrange(120))
        data.append((rng.choice(["a", "b"]), key, bytes([rng.randrange(9)]), rng.randrange(60), i, time))
    return frame(spark, data, CHANGES)


@pytest.mark.parametrize(
    "order, span, dated",
    [
        (snapshots.EVENT_ORDER, 7, False),
        (snapshots.EVENT_ORDER, None, True),
        (snapshots.LOG_ORDER, 7, False),
        (snapshots.LOG_ORDER, None, True),
    ],
)
def test_delegations_at_any_moment(spark, order, span, dated):
    events = changes(spark, dated)
    kept = scale.keep(history.delegation_intervals(events, order, span), "intervals")
    for moment in ("2023-12-31 00:00:00", day(0), day(40), "2024-02-20 12:00:00", day(119), "2025-01-01 00:00:00"):
        want = snapshots.current_delegations(events, moment, order)
        assert rows(history.delegations_at(kept, moment)) == rows(want)


def test_voting_power_at_any_moment(spark):
    rng, data = random.Random(5), []
    for i in range(200):
        key = b"\x01" if i % 4 else rng.choice([b"\x02", None])
        block = rng.randrange(50)  # ties in block and index keep all their rows
        time = None if i % 31 == 0 else day(block + rng.randrange(3))
        data.append((key, Decimal(rng.randrange(100)), Decimal(i), block, rng.randrange(2), time))
    votes = frame(spark, data, VOTES)
    kept = scale.keep(history.vote_intervals(votes, span=6), "intervals")
    assert rows(history.voting_power_at(kept, 0)) == rows(snapshots.voting_power_snapshot(votes, 0))
    for n in (0, 1, 20, 33, 60):
        want = snapshots.voting_power_snapshot(votes, 0, day(n))
        assert rows(history.voting_power_at(kept, 0, day(n))) == rows(want)


def transfers(spark):
    rng, data = random.Random(7), []
    for i in range(400):
        sides = [bytes([rng.randrange(6)]) if rng.random() < 0.9 else None for _ in range(2)]
        value = None if i % 37 == 0 else Decimal(rng.randrange(10**20))
        data.append((rng.choice(["a", "b"]), *sides, value, None if i % 41 == 0 else day(rng.randrange(150))))
    data += [("a", b"\x63", b"\x64", None, day(3)), ("a", b"\x65", b"\x66", Decimal(5), day(149))]
    return frame(spark, data, TRANSFERS)


@pytest.mark.parametrize("period, limit", [("DAY", 10**6), ("WEEK", 0), ("MONTH", 0), ("QUARTER", 10**6), ("YEAR", 0)])
def test_ledger_at_equals_the_full_sum(spark, period, limit):
    moves = transfers(spark)
    wanted = [("a", bytes([k])) for k in (0, 1, 2, 0x63, 0x64, 0x66, 0x70)] + [("b", b"\x03"), ("c", b"\x01")]
    listed = Sized(spark.createDataFrame(wanted, "chain string, delegator binary"), len(wanted))
    kept = scale.keep(history.balance_history(moves, period), "balances")
    for moment in (day(0), day(28), "2024-03-05 13:00:00", day(149), "2026-01-01 00:00:00"):
        sofar = moves.where(F.col("evt_block_time").isNull() | (F.col("evt_block_time") <= F.lit(moment).cast("timestamp_ntz")))
        want = ledger.ledger_balances(sofar, listed, 4)
        found = history.ledger_at(kept, moves, listed, moment, 4, period, broadcast_rows=limit)
        assert rows(found.select(*want.columns)) == rows(want)


def test_a_balance_over_38_digits_raises_if_asked_for(spark):
    huge = Decimal(9 * 10**37)
    moves = frame(spark, [("a", b"\x01", b"\x02", huge, day(n)) for n in (1, 30, 60)], TRANSFERS)
    kept = scale.keep(history.balance_history(moves), "balances")
    ask = lambda key, at: history.ledger_at(
        kept, moves, Sized(spark.createDataFrame([("a", key)], "chain string, delegator binary"), 1), at
    ).collect()
    assert ask(b"\x02", day(10))[0]["units"] == huge
    assert ask(b"\x05", day(100)) == []
    with pytest.raises(PySparkException, match="over 38 digits"):
        ask(b"\x02", day(100))


def test_kept_history_is_clustered_and_filtered_in_the_scan(spark, tmp_path):
    tables = benchmark_tables(spark, SF_DIR, "delegate_changed", "transfers")
    kept = history.keep(history.delegation_intervals(tables.delegate_changed), str(tmp_path / "intervals"))
    found = history.delegations_at(kept, CONFIG.as_of)
    text = plan(found)
    assert "Window" not in text and "Exchange" not in text and text.count("FileScan") == 1
    assert "LessThanOrEqual(valid_from" in text and "GreaterThan(valid_to" in text
    assert rows(found) == rows(snapshots.current_delegations(tables.delegate_changed, CONFIG.as_of))
    balances = history.keep(history.balance_history(tables.transfers), str(tmp_path / "balances"))
    listed = scale.pin(found.select("chain", "delegator"), "listed")
    text = plan(history.ledger_at(balances, tables.transfers, listed, CONFIG.as_of))
    assert text.count("lineitem.parquet") == 1
    assert re.search(r"GreaterThanOrEqual\(l_shipdate,2001-08-01T00:00\), LessThanOrEqual\(l_shipdate,2001-08-01T12:00", text)


def test_time_bounds_reach_the_scans(spark):
    tables = benchmark_tables(spark, SF_DIR)
    for text, column in (
        (plan(snapshots.current_delegations(tables.delegate_changed, "1998-06-15 00:00:00")), "o_orderdate"),
        (plan(snapshots.voting_power_change(tables.votes_changed, "2024-01-31 00:00:00", "1 day")), "ts"),
        (plan(reports._moved_by(tables.transfers, CONFIG)), "l_shipdate"),
    ):
        assert re.search(rf"PushedFilters: \[[^\]]*LessThanOrEqual\({column},", text), text


def test_report_from_history_equals_the_one_from_events(spark):
    tables = benchmark_tables(spark, SF_DIR, "delegate_changed", "transfers", "address_names")
    kept = replace(
        tables,
        delegation_intervals=scale.keep(history.delegation_intervals(tables.delegate_changed), "intervals"),
        balance_history=scale.keep(history.balance_history(tables.transfers), "balances"),
    )
    assert rows(reports.all_chain_delegators(kept, CONFIG)) == rows(reports.all_chain_delegators(tables, CONFIG))


def numbers():
    rng = random.Random(9)
    few = [Decimal(x) for x in (0, 0, 0, 1, -1, 7, 7, 10**37, -(10**37), 10**38 - 1, -(10**38) + 1)]
    many = [Decimal(rng.randrange(-(10**12), 10 ** rng.randrange(1, 38))) for _ in range(400)]
    return few + many + [Decimal(5)] * 60 + [None] * 7


@pytest.mark.parametrize("buckets", [16, 1024])
def test_places_equal_a_sort(spark, buckets):
    values = numbers()
    df = spark.createDataFrame([(v,) for v in values], "v decimal(38,0)")
    falling = sorted((v for v in values if v is not None), reverse=True)
    ks = [1, 2, 50, 200, 300, len(falling), len(falling) + 1, len(values) + 1]
    found = selection.places(df, "v", {str(k): (F.lit(True), k) for k in ks}, buckets)
    for k in ks:
        value = falling[k - 1] if k <= len(falling) else None
        place = found[str(k)]
        assert place.value == value
        if value is not None:
            assert (place.above, place.ties) == (sum(v > value for v in falling), falling.count(value))


def test_values_at_ranks_break_ties_and_keep_groups(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *map(Decimal, range(6))]), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, units decimal(38,0), days bigint")
    ks = [1, 20, 60, 90, 1000]
    found = selection.values_at_ranks(df, ks, "g", ["units", "days"])
    assert not re.search(r"\bSort\b|Window|Exchange", plan(found))
    want = set()
    for g in ("a", "b", None):
        mine = sorted(((u, d) for h, u, d in data if h == g), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, -(r[1] or 0)))
        want |= {(g, k, *mine[k - 1]) for k in ks if k <= len(mine)}
    assert set(map(tuple, found.collect())) == want


def test_balance_at_ranks_where_ties_differ(spark):
    data = [(Decimal(u), b, a, "x") for u, b, a in ((5, 5.0, "a"), (5, 5.5, "c"), (5, 5.25, "b"), (2, 2.0, "d"), (9, 9.0, "e"))]
    data += [(None, None, "n", "x"), (None, 7.0, "m", "x")]
    df = spark.createDataFrame(data, "units decimal(38,0), balance double, address string, chain string")
    ks = [1, 2, 3, 4, 5, 6, 7, 8]
    want = holders.balance_at_ranks(Sized(df, 7), ks).first()
    assert tuple(want) == (9.0, 5.0, 5.25, 5.5, 2.0, 7.0, None, None)
    assert holders.balance_at_ranks(Sized(df, 7), ks, window_rows=0).first() == want


def test_thresholds_by_counting(spark):
    tables = benchmark_tables(spark, SF_DIR, "delegate_changed", "transfers", "address_names")
    state = reports.current_state(tables, CONFIG)
    ks = (1, 3, 10, 77, 5000)
    board = leaderboard.delegator_leaderboard_multi(state.holdings, tables.address_names, CONFIG.decimals)
    found = leaderboard.thresholds(state.holdings, tables.address_names, ks, CONFIG.decimals)
    assert rows(found) == rows(metrics.rank_thresholds(board, ks).select(*found.columns))
    assert not re.search(r"Window|row_number", plan(found))


def test_reports_share_one_reading(spark, monkeypatch):
    """Four reports of one run: the events are read once, names are looked up and ranks made once."""
    tables = benchmark_tables(spark, SF_DIR, "delegate_changed", "transfers", "address_names")
    alone = [f(tables, CONFIG) for f in (reports.all_chain_delegators, reports.chain_totals_report, reports.threshold_report)]
    kept, keep = [], scale.keep
    for module in (scale, reports, leaderboard):
        if hasattr(module, "keep"):
            monkeypatch.setattr(module, "keep", lambda df, name: (kept.append((name, plan(df))), keep(df, name))[1])
    shared = reports.Shared(tables, CONFIG)
    together = [
        f(tables, shared=shared) for f in (reports.all_chain_delegators, reports.chain_totals_report, reports.threshold_report)
    ]
    ranges = reports.holding_size_ranges(tables, shared=shared)
    assert [rows(df) for df in together] == [rows(df) for df in alone]
    assert rows(ranges) == rows(reports.holding_size_ranges(tables, CONFIG, shared))
    names = [name for name, _ in kept]
    assert names.count("delegations") == names.count("holdings") == names.count("ranked") == 1
    texts = [text for _, text in kept] + [plan(df) for df in (*together, ranges)]
    assert sum(t.count("lineitem.parquet") for t in texts) == sum(t.count("orders.parquet") for t in texts) == 1


def test_bitmap_drops_unlisted_keys_in_the_scan(spark):
    listed = spark.range(0, 200_000, 7).selectExpr("concat('c', id % 3) AS chain", "cast(string(id) AS binary) AS delegator")
    listed = scale.pin(listed.union(spark.sql("SELECT 'x', CAST(NULL AS BINARY)")), "listed")
    rows_ = spark.range(200_000).selectExpr("concat('c', id % 3) AS chain", "cast(string(id) AS binary) AS delegator", "id")
    left = scale.maybe_listed(rows_, listed, ["chain", "delegator"])
    text = plan(left)
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    ids = {r["id"] for r in left.select("id").collect()}
    assert ids >= set(range(0, 200_000, 7)) and len(ids) < 200_000 / 7 + 0.2 * 200_000
    assert scale.maybe_listed(rows_, Sized(listed.df, scale.BITMAP_BITS), ["chain", "delegator"]) is rows_


def test_bucketed_ledger_moves_nothing(spark, tmp_path):
    tables = benchmark_tables(spark, SF_DIR, "delegate_changed", "transfers")
    current = snapshots.current_delegations(tables.delegate_changed, CONFIG.as_of).select("chain", "delegator")
    held = layout.write_bucketed(current, "bucketed_delegations", 8, str(tmp_path / "delegations"))
    sums = layout.write_bucketed(layout.period_legs(tables.transfers), "bucketed_legs", 8, str(tmp_path / "legs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = ledger.ledger_balances(sums, Sized(held, held.count()), 4, legs=layout.period_units, broadcast_rows=0)
        text = plan(found)
        assert "SortMergeJoin" in text and "Exchange hashpartitioning" not in text
        assert rows(found) == rows(ledger.ledger_balances(tables.transfers, scale.pin(current, "held"), 4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_delegations")
        spark.sql("DROP TABLE bucketed_legs")


def test_ties_are_found_by_an_aggregate(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([1, None]), i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, x long, y long, i long")
    found = snapshots.latest_per_key(df, ["k"], ["x", "y"], ties="all")
    low = lambda v: -1 if v is None else v
    want = {
        r for r in data
        if (low(r[1]), low(r[2])) == max((low(s[1]), low(s[2])) for s in data if s[0] == r[0])
    }
    assert {tuple(r) for r in found.collect()} == want and len(want) > 3
    assert "Window" not in plan(found)

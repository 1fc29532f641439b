"""Exact semantics on hand-made cases."""

from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import frames as f
from stakeline.functions import times
from stakeline.functions.times import elapsed_days
from stakeline.operators import delegates, holders, labels, leaderboard, ledger, metrics, snapshots
from stakeline.plans import reports
from stakeline.scale import Sized, sized
from stakeline.sources import tables as src

E = "Ethereum"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_filter_follows_ranking(spark):
    """A delegation younger than a day takes rank 1 and is then dropped."""
    t = f.delegating(spark, [(E, 1, 50, 0), (E, 2, 30, 5), (E, 3, 20, 5)])
    out = reports.all_chain_delegators(t, f.CFG)
    assert rows(out, "rank", "w_delegated", "pct_of_delegated") == [(2, 30.0, 0.3), (3, 20.0, 0.2)]
    assert rows(out, "tokens_for_top_1", "tokens_for_top_2")[0] == (None, 30.0)
    assert rows(out, "total_w_delegated_blockchain", "num_of_stakers")[0] == (100.0, 2)


def test_latest_breaks_time_ties_by_log_position(spark):
    noon = "2024-01-05 12:00:00"
    df = f.changes(spark, [(E, 1, 11, 7, 1, noon), (E, 1, 12, 7, 3, noon), (E, 1, 13, 7, 2, noon)])
    now = snapshots.current_delegations(df, f.CFG.as_of)
    assert [bytearray(r.to_delegate) for r in now.collect()] == [f.raw(12)]
    tied = snapshots.latest_per_key(df, ["delegator"], ["evt_block_number"], ties="all")
    assert tied.count() == 3


def test_elapsed_days_are_whole_days(spark):
    df = spark.sql(
        "SELECT explode(array(TIMESTAMP_NTZ'2024-01-30 00:00:01', TIMESTAMP_NTZ'2024-01-30 00:00:00',"
        " TIMESTAMP_NTZ'2024-01-31 23:00:00')) AS ts"
    )
    assert [r[0] for r in df.select(elapsed_days("ts", f.CFG.as_of)).collect()] == [0, 1, 0]


def test_ledger_nets_and_omits(spark):
    """Self-transfers net zero, holders without transfers are absent, debits may exceed credits."""
    held = spark.createDataFrame(
        [(E, f.raw(k)) for k in (1, 2, 3, 4)], "chain string, delegator binary"
    )
    moves = f.transfers(spark, [(E, 1, 1, 9), (E, 2, 3, 5), ("Base", 0, 4, 8)])
    for limit in (0, 100):
        out = ledger.ledger_balances(moves, sized(held), 0, broadcast_rows=limit)
        assert {(r.delegator[-1], int(r.units)) for r in out.collect()} == {(1, 0), (2, -5), (3, 5)}


def test_amounts_over_38_digits_are_rejected(spark):
    assert f.transfers(spark, [(E, 0, 1, 10**38 - 1)]).first().value == 10**38 - 1
    with pytest.raises(PySparkException, match="38 digits"):
        f.transfers(spark, [(E, 0, 1, 10**38)]).collect()


def test_amounts_stay_exact(spark):
    """Sums a double would round."""
    t = f.delegating(spark, [(E, 1, 10**25, 3), (E, 2, 1, 3)])
    state = reports.current_state(t, f.CFG)
    assert state.holdings.df.agg(F.sum("units")).first()[0] == 10**25 + 1


BOOK = [(900, "A", ""), (900, "B", ""), (900, "B", "")]


def test_repeated_names_single_chain(spark):
    """Distinct rows, total over distinct rows, share over all repeats."""
    t = f.delegating(spark, [(E, 1, 60, 3), (E, 2, 40, 3)], address_names=f.names(spark, BOOK))
    out = reports.single_chain_delegators(t, E, f.CFG)
    assert rows(out, "rank", "w_delegated", "delegate_name") == [
        (1, 60.0, "A"),
        (2, 60.0, "B"),
        (3, 40.0, "A"),
        (4, 40.0, "B"),
    ]
    assert rows(out, "pct_of_delegated", "total_w_delegated")[0] == (60 / 300, 200.0)


def test_repeated_names_multi_chain(spark):
    """Each repeat is a row with its own rank; plain totals ignore repeats."""
    t = f.delegating(spark, [(E, 1, 60, 3), (E, 2, 40, 3)], address_names=f.names(spark, BOOK))
    out = reports.chain_totals_report(t, f.CFG)
    assert [r[0] for r in rows(out, "delegate_name")] == ["A", "B", "B", "A", "B", "B"]
    assert rows(out, "total_w_delegated_blockchain", "total_w_delegated_ethereum")[0] == (300.0, 100.0)
    assert rows(out, "num_of_stakers", "unique_delegators")[0] == (2, 2)


def test_unknown_delegate_has_no_name(spark):
    out = reports.single_chain_delegators(f.delegating(spark, [(E, 1, 60, 3)]), E, f.CFG)
    row = out.first()
    assert (row.delegate_name, row.delegate_address, row.delegate_address_link) == (None,) * 3
    assert row.delegator_address == f.addr(1)


def test_null_name_falls_back_to_address(spark):
    t = f.delegating(
        spark, [(E, 1, 60, 3)], address_names=f.names(spark, [(900, None, ""), (900, f.addr(900), "")])
    )
    out = reports.single_chain_delegators(t, E, f.CFG)
    assert rows(out, "delegate_name", "total_w_delegated") == [(f.addr(900), 60.0)]


def test_grand_total_with_an_empty_chain(spark):
    t = f.delegating(spark, [(E, 1, 60, 3), ("Base", 2, 40, 3)])
    assert reports.threshold_report(t, f.CFG).first().total_w_delegated_all is None
    assert reports.all_chain_delegators(t, f.CFG).first().total_w_delegated_all == 100.0
    row = reports.chain_totals_report(t, f.CFG).first()
    assert (row.total_w_delegated_base, row.total_w_delegated_optimism) == (40.0, None)


def test_unique_delegators_differ_by_base(spark):
    """Delegators without a transfer count as delegators, not as holders."""
    t = f.delegating(spark, [(E, 1, 60, 3)])
    t = replace(
        t,
        delegate_changed=t.delegate_changed.union(
            f.changes(spark, [(E, 5, 900, 1, 0, "2024-01-02 00:00:00")])
        ),
    )
    assert reports.threshold_report(t, f.CFG).first().unique_delegators == 2
    assert reports.all_chain_delegators(t, f.CFG).first().unique_delegators == 1


def test_zero_total_empties_the_chain(spark):
    t = f.delegating(spark, [(E, 1, 60, 3), (E, 2, 0, 3)])
    t = replace(t, transfers=f.transfers(spark, [(E, 2, 1, 60)]))
    assert reports.all_chain_delegators(t, f.CFG).count() == 0
    assert reports.single_chain_delegators(t, E, f.CFG).count() == 0


def test_negative_total_empties_the_chain(spark):
    t = f.delegating(spark, [(E, 1, 60, 3), (E, 2, 0, 3)])
    t = replace(t, transfers=f.transfers(spark, [(E, 2, 1, 60), (E, 2, 7, 100)]))
    assert reports.all_chain_delegators(t, f.CFG).count() == 0


def test_no_events_at_all(spark):
    t = f.delegating(spark, [(E, 1, 60, 3)])
    t = replace(t, delegate_changed=t.delegate_changed.limit(0))
    for report in (reports.all_chain_delegators, reports.threshold_report, reports.holding_size_ranges):
        assert report(t, f.CFG).count() == 0


def test_histogram_counts_rows_and_keeps_order(spark):
    t = f.delegating(spark, [(E, 1, 500, 3), ("Base", 1, 99, 3), (E, 3, 10, 3), (E, 4, 9, 3)])
    out = reports.holding_size_ranges(t, f.CFG)
    assert rows(out, "*") == [("<10", 1), ("10-<100", 2), ("100-<1k", 1)]


def test_default_labels():
    cfg = reports.Config()
    assert [metrics.range_label(cfg.edges, cfg.last_edge_label, i) for i in range(8)] == [
        "<100", "100-<500", "500-<1k", "1k-<2k", "2k-<5k", "5k-<10k", "10k-<25k", "25k-<50k",
    ]


# Delegates

OLD, NEW = "2024-01-01 00:00:00", "2024-01-30 12:00:00"
VOTES_CFG = replace(f.CFG, top_n=2, quorum=150)


def voting(spark, vote_rows, change_rows=(), **lookups):
    return src.Tables(
        votes_changed=f.votes(spark, vote_rows),
        delegate_changed=f.changes(spark, list(change_rows)),
        address_names=f.names(spark, lookups.get("names", ())),
        ens=f.ens(spark, lookups.get("ens", ())),
        labels=f.labels(spark, lookups.get("labels", ())),
    )


def test_power_now_and_a_day_ago(spark):
    v = f.votes(spark, [(1, 5, 1, 0, OLD), (1, 9, 2, 0, NEW), (2, 7, 2, 1, NEW), (3, 4, 1, 2, OLD)])
    out = snapshots.voting_power_change(v, f.CFG.as_of, "1 day")
    assert {(r.delegate[-1], int(r.units), int(r.prev_units)) for r in out.collect()} == {
        (1, 9, 5),
        (2, 7, 0),
        (3, 4, 4),
    }


def test_power_follows_the_log_not_the_clock(spark):
    """The last event by block and index counts even if its clock is behind."""
    v = f.votes(spark, [(1, 5, 9, 0, OLD), (1, 9, 2, 0, NEW)])
    out = snapshots.voting_power_change(v, f.CFG.as_of, "1 day").first()
    assert (int(out.units), int(out.prev_units)) == (5, 5)


def test_top_by_present_or_past_power(spark):
    """Delegate 3 was first a day ago and stays by name; zero address and the rest do not."""
    t = voting(
        spark,
        [(0, 999, 1, 9, OLD), (1, 100, 1, 0, OLD), (2, 90, 2, 0, NEW), (4, 8, 2, 1, NEW)]
        + [(3, 500, 1, 1, OLD), (3, 1, 2, 2, NEW)],
    )
    out = {r.delegate: r for r in reports.top_delegates(t, VOTES_CFG).collect()}
    assert set(out) == {f.addr(1), f.addr(2), f.addr(3), "Other"}
    assert [out[f.addr(k)].delegate_rank for k in (1, 2, 3)] == [1, 2, 3]
    assert (out["Other"].delegate_rank, out["Other"].delegate_name) == (3, "Other")
    assert out[f.addr(3)].vp_change_30d == -499.0
    assert out[f.addr(2)].pct_vp_change_30d is None


def test_delegate_without_delegators_counts_one(spark):
    t = voting(
        spark,
        [(1, 100, 1, 0, OLD), (2, 90, 1, 1, OLD)],
        [(E, 11, 1, 1, 0, OLD), (E, 12, 1, 1, 1, OLD), ("Base", 13, 2, 1, 2, OLD)],
    )
    out = {r.delegate: r for r in reports.top_delegates(t, VOTES_CFG).collect()}
    assert [out[f.addr(k)].num_delegators for k in (1, 2)] == [2, 1]
    assert out[f.addr(1)].pct_delegators == 2 / 3


def test_rest_with_equal_power_counts_power_once(spark):
    t = voting(
        spark,
        [(1, 100, 1, 0, OLD), (2, 90, 1, 1, OLD)] + [(k, 5, 1, k, OLD) for k in (3, 4, 5)] + [(6, 4, 1, 6, OLD)],
        [(E, 20 + k, k, 1, k, OLD) for k in (3, 4)] + [(E, 30, 3, 1, 9, OLD)],
    )
    other = reports.top_delegates(t, VOTES_CFG).where("delegate = 'Other'").first()
    assert other.dt_voting_power == 9.0
    assert other.num_delegators == 5
    assert other.pct_voting_power == 9 / 209


def test_tied_ranks_share_the_running_sum(spark):
    t = voting(spark, [(1, 60, 1, 0, OLD), (2, 60, 1, 1, OLD), (3, 40, 1, 2, OLD)])
    cfg = replace(VOTES_CFG, top_n=3)
    out = {r.delegate[-1]: r for r in reports.top_delegates(t, cfg).collect()}
    assert [out[k].delegate_rank for k in "123"] == [1, 1, 2]
    assert [out[k].running_dt_voting_power for k in "123"] == [120.0, 120.0, 160.0]
    assert out["1"].num_delegates_to_majority == 1.0
    assert out["1"].num_delegates_to_quorum == 2.0
    never = reports.top_delegates(t, replace(cfg, quorum=1000)).first()
    assert never.num_delegates_to_quorum == 1e18


def test_label_precedence(spark):
    """Book first, then ENS and institutions; empty texts count as missing."""
    wanted = spark.createDataFrame([(f.raw(k),) for k in range(1, 7)], "address binary")
    out = labels.resolve_labels(
        Sized(wanted, 6),
        f.names(spark, [(1, "Ann", ""), (1, "Al", "ann.eth"), (2, "", ""), (6, None, None)]),
        f.ens(spark, [(1, "no.eth"), (2, "no.eth"), (3, "c.eth"), (3, "b.eth"), (5, None)]),
        f.labels(
            spark,
            [(2, "institution", "no"), (3, "institution", "Z"), (3, "institution", "Y")]
            + [(3, "institution", "Y"), (4, "other", "no")],
        ),
    )
    assert {r.address[-1]: (r.name, r.ens) for r in out.collect()} == {
        1: ("Al,Ann", ",ann.eth"),
        2: (None, None),
        3: ("Y,Z", "b.eth,c.eth"),
        4: (None, None),
        5: (None, None),
        6: (None, None),
    }


def test_names_and_links(spark):
    t = voting(
        spark,
        [(1, 100, 1, 0, OLD), (2, 90, 1, 1, OLD)],
        names=[(1, "Ann", "ann.eth")],
    )
    cfg = replace(VOTES_CFG, vote_page="v?", breakdown_page="b?", breakdown_caption="c")
    out = {r.delegate[-1]: r for r in reports.top_delegates(t, cfg).collect()}
    a, b = f.addr(1), f.addr(2)
    assert out["1"].delegate_name == (
        f'<a href="v?{a}" target ="_blank">Ann - ann.eth - 0x00...0001</a>'
    )
    assert out["2"].delegate_name == f'<a href="v?{b}" target ="_blank">{b}</a>'
    assert out["1"].delegator_link == f'<a href="b?{a}" target="_blank">c</a>'
    assert (out["1"].delegate_name_raw, out["2"].delegate_name_raw) == ("Ann", b)


def test_one_row_per_delegate(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "delegate string, delegate_name string")
    assert rows(delegates.one_per_delegate(df).orderBy("delegate"), "*") == [("a", "y", 1), ("b", None, 1)]


# Holders


def test_emptied_wallet_keeps_its_last_balance(spark):
    b = f.balances(
        spark,
        [("base", 1, 50, "2024-01-01 00:00:00"), ("base", 1, 0, "2024-01-02 00:00:00")]
        + [("base", 2, 30, "2024-01-01 00:00:00"), ("base", 2, 20, "2024-01-03 00:00:00")]
        + [("ethereum", 1, 7, "2024-01-01 00:00:00")],
    )
    out = reports.token_holders(src.Tables(balances=b), f.TOKEN.lower(), replace(f.CFG, ks=(2, 4)))
    assert rows(out, "blockchain", "balance", "sep_balance") == [
        ("base", 50.0, 70.0),
        ("base", 20.0, 70.0),
        ("ethereum", 7.0, 7.0),
    ]
    assert rows(out, "total_balance", "top_2_balance", "top_4_balance", "num_of_stakers")[0] == (
        77.0, 20.0, None, 3,
    )


def test_balances_in_tokens_or_units(spark):
    """One chain gives base units, the other tokens."""
    when = "timestamp_ntz'2024-01-01 00:00:00' AS block_time"
    units = spark.sql(f"SELECT '{f.addr(1)}' AS address, '{f.TOKEN}' AS token_address, 25 AS balance_raw, {when}")
    tokens = spark.sql(f"SELECT '{f.addr(2)}' AS address, '{f.TOKEN}' AS token_address, 1.5D AS balance, {when}")
    out = src.balances(spark, {"optimism": units, "base": tokens}, decimals=1)
    assert {(r.chain, r.balance, int(r.units)) for r in out.collect()} == {
        ("optimism", 2.5, 25),
        ("base", 1.5, 15),
    }


def test_global_rank(spark):
    t = f.delegating(spark, [(E, 1, 50, 3), ("Base", 2, 70, 3), (E, 3, 20, 3)])
    state = reports.current_state(t, f.CFG)
    board = leaderboard.delegator_leaderboard_multi(state.holdings, t.address_names, 0)
    out = leaderboard.global_rank(board).orderBy("rank")
    assert rows(out, "rank", "chain") == [(1, "Base"), (2, E), (3, E)]


def test_latest_holdings_filters_token(spark):
    b = f.balances(spark, [("base", 1, 50, "2024-01-01 00:00:00")])
    assert holders.latest_holdings(b, f.addr(3)).count() == 0
    plain = bytes.fromhex(f.TOKEN[2:])
    for token in (f.TOKEN, f.TOKEN.lower(), plain, F.lit(plain)):
        assert holders.latest_holdings(b, token).count() == 1


def test_holders_of_a_chain_without_a_name(spark):
    """Every holder is a row, also where the chain is NULL."""
    b = f.balances(spark, [(None, 1, 6, "2024-01-01 00:00:00"), ("base", 2, 4, "2024-01-01 00:00:00")])
    out = reports.token_holders(src.Tables(balances=b), f.TOKEN, replace(f.CFG, ks=(1,)))
    assert rows(out, "blockchain", "balance", "sep_balance", "total_balance", "num_of_stakers") == [
        (None, 6.0, 6.0, 10.0, 2),
        ("base", 4.0, 4.0, 10.0, 2),
    ]


def test_a_past_moment_sees_no_later_event(spark):
    changes = f.changes(
        spark, [(E, 1, 11, 1, 0, "2024-01-01 00:00:00"), (E, 1, 12, 9, 0, "2024-03-01 00:00:00")]
    )
    now = snapshots.current_delegations(changes, "2024-01-31").first()
    assert (bytearray(now.to_delegate), now.days_delegated) == (f.raw(11), 30)
    t = src.Tables(
        delegate_changed=changes,
        transfers=f.transfers(spark, [(E, 0, 1, 5, "2024-01-02 00:00:00"), (E, 0, 1, 7, "2024-02-02 00:00:00")]),
        address_names=f.names(spark),
    )
    row = reports.all_chain_delegators(t, f.CFG).first()
    assert (row.w_delegated, row.days_delegated) == (5.0, 30)
    votes = f.votes(spark, [(1, 10, 1, 0, "2024-01-05 00:00:00"), (1, 99, 9, 0, "2024-02-05 00:00:00")])
    power = snapshots.voting_power_change(votes, "2024-01-31", "1 day").first()
    assert (int(power.units), int(power.prev_units)) == (10, 10)


def test_a_past_moment_needs_the_times_of_transfers(spark):
    timeless = f.transfers(spark, [(E, 0, 1, 5)]).withColumn("evt_block_time", F.lit(None).cast("timestamp_ntz"))
    t = src.Tables(
        delegate_changed=f.changes(spark, [(E, 1, 11, 1, 0, "2024-01-01 00:00:00")]),
        transfers=timeless,
        address_names=f.names(spark),
    )
    with pytest.raises(PySparkException, match="no evt_block_time"):
        reports.all_chain_delegators(t, f.CFG).collect()
    without_column = replace(t, transfers=timeless.drop("evt_block_time"))
    with pytest.raises(PySparkException, match="no evt_block_time"):
        reports.all_chain_delegators(without_column, f.CFG).collect()
    assert reports.all_chain_delegators(t, replace(f.CFG, as_of=None)).first().w_delegated == 5.0


def test_moments_with_a_zone(spark):
    from datetime import datetime, timedelta, timezone

    at = datetime(2024, 1, 31, tzinfo=timezone(timedelta(hours=-5)))
    for moment_ in (at, at.isoformat(), "2024-01-31 05:00:00", datetime(2024, 1, 31, 5)):
        assert str(spark.range(1).select(times.moment(moment_)).first()[0]) == "2024-01-31 05:00:00"


def test_overflow_stops_only_who_asks(spark):
    """An unwanted address may hold more than 38 digits; a wanted one may not."""
    big = 9 * 10**37
    moves = f.transfers(spark, [(E, 0, 1, big), (E, 0, 2, big), (E, 0, 3, 5)])
    three = spark.createDataFrame([(E, f.raw(3))], "chain string, delegator binary")
    zero = spark.createDataFrame([(E, f.raw(0))], "chain string, delegator binary")
    for limit in (0, 100):
        held = ledger.ledger_balances(moves, sized(three), 0, broadcast_rows=limit).collect()
        assert [int(r.units) for r in held] == [5]
        with pytest.raises(PySparkException, match="38 digits"):
            ledger.ledger_balances(moves, sized(zero), 0, broadcast_rows=limit).collect()


def test_any_chain_name(spark):
    odd = ("Polygon zkEVM", "it's", 'say "hi"')
    held = spark.createDataFrame([(c, 1, 2 + i) for i, c in enumerate(odd)], "chain string, rank long, units long")
    totals = metrics.chain_totals(held, odd, 0).first()
    assert [totals[f"total_w_delegated_{c.lower()}"] for c in odd] == [2.0, 3.0, 4.0]
    board = held.withColumn("w_delegated", F.col("units").cast("double"))
    wide = metrics.rank_thresholds_wide(board, (1,), {c: c for c in odd}).first()
    assert [wide[f"{c}_top_1"] for c in odd] == [2.0, 3.0, 4.0]


def test_events_without_a_time_count_now_and_are_refused_for_a_past_moment(spark):
    bare = F.lit(None).cast("timestamp_ntz")
    t = voting(spark, [(1, 10, 1, 0, OLD), (1, 70, 2, 0, OLD), (2, 50, 1, 1, OLD)], [(E, 5, 1, 1, 0, OLD), (E, 5, 2, 2, 0, OLD)])
    last = F.col("evt_block_number") == 2
    when = F.when(last, bare).otherwise(F.col("evt_block_time"))
    votes, changes = t.votes_changed.withColumn("evt_block_time", when), t.delegate_changed.withColumn("evt_block_time", when)
    now = replace(VOTES_CFG, as_of=None)
    out = {r.delegate: r for r in reports.top_delegates(replace(t, votes_changed=votes, delegate_changed=changes), now).collect()}
    assert (out[f.addr(1)].total_voting_power, out[f.addr(1)].vp_change_30d) == (120.0, 60.0)
    latest = snapshots.current_delegations(changes, f.CFG.as_of, snapshots.LOG_ORDER).first()
    assert latest.to_delegate == f.raw(2) and latest.evt_block_time is None
    for timeless in (replace(t, votes_changed=votes), replace(t, delegate_changed=changes)):
        with pytest.raises(PySparkException, match="no evt_block_time"):
            reports.top_delegates(timeless, VOTES_CFG).collect()

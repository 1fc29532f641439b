"""Every operator and report as a query ``(spark, sf_dir) -> DataFrame`` over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeline.config import CHAIN_PREFIX
from stakeline.functions.addresses import ZERO, address, short_addr, to_text, with_text
from stakeline.functions.amounts import to_tokens
from stakeline.functions.links import delegate_anchor, explorer_url, html_link
from stakeline.functions.times import up_to
from stakeline.operators import (
    delegates,
    history,
    holders,
    labels,
    leaderboard,
    ledger,
    metrics,
    snapshots,
)
from stakeline.plans import reports
from stakeline.scale import pin
from stakeline.sources import tables as src
from stakeline.sources.benchmark import (
    CONFIG,
    TOKEN,
    VOTES_CONFIG,
    benchmark_tables,
    raw_table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LEDGER = ("delegate_changed", "transfers")
BOARD = (*LEDGER, "address_names")
VOTES = ("delegate_changed", "votes_changed", "address_names", "ens", "labels")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _plain(df: DataFrame) -> DataFrame:
    """Result types both engines share: text addresses, DOUBLE amounts."""
    return with_text(
        df.select(
            *[
                F.col(f"`{name}`").cast("double").alias(name) if kind.startswith("decimal") else f"`{name}`"
                for name, kind in df.dtypes
            ]
        )
    )


def _ethereum(df: DataFrame) -> DataFrame:
    return df.where("chain = 'Ethereum'")


# Scans


@query
def scan_delegate_changed(spark, sf_dir):
    return _plain(benchmark_tables(spark, sf_dir, "delegate_changed").delegate_changed)


@query
def scan_transfers(spark, sf_dir):
    return _plain(benchmark_tables(spark, sf_dir, "transfers").transfers)


@query
def scan_votes_changed(spark, sf_dir):
    return _plain(benchmark_tables(spark, sf_dir, "votes_changed").votes_changed)


@query
def scan_votes_changed_zoned(spark, sf_dir):
    """Event times as instants, whatever the session's time zone."""
    raw = raw_table(spark, sf_dir, "votes_changed")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("evt_block_time"))
    return _plain(src.votes_changed(spark, raw.withColumn("evt_block_time", F.timestamp_micros(micros))))


def _by_chain(spark, sf_dir, name: str) -> dict[str, DataFrame]:
    raw = raw_table(spark, sf_dir, name)
    return {c: raw.where(F.col("chain") == c).drop("chain") for c in CONFIG.chains}


@query
def scan_transfers_per_chain_tables(spark, sf_dir):
    """One event table per chain."""
    return _plain(src.transfers(spark, _by_chain(spark, sf_dir, "transfers")))


@query
def scan_balances(spark, sf_dir):
    return _plain(benchmark_tables(spark, sf_dir, "balances").balances)


@query
def scan_address_names(spark, sf_dir):
    return _plain(benchmark_tables(spark, sf_dir, "address_names").address_names)


@query
def scan_ens_names(spark, sf_dir):
    return _plain(benchmark_tables(spark, sf_dir, "ens").ens)


@query
def scan_category_labels(spark, sf_dir):
    return _plain(benchmark_tables(spark, sf_dir, "labels").labels)


@query
def union_chains(spark, sf_dir):
    """One balance table per chain, one of them in base units only, the others in tokens only."""
    raw = raw_table(spark, sf_dir, "balances").where(F.lower("token_address") == TOKEN)

    def one(chain: str, spare: str) -> DataFrame:
        return raw.where(F.col("chain") == chain).drop("chain", spare)

    per_chain = {
        "ethereum": one("ethereum", "balance_raw"),
        "optimism": one("optimism", "balance"),
        "arbitrum": one("arbitrum", "balance_raw"),
        "base": one("base", "balance_raw"),
    }
    united = src.balances(spark, per_chain, CONFIG.decimals)
    return _plain(united.where("balance != 0").drop("token_address", "units"))


# Latest rows and delegations


@query
def latest_row_number(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "delegate_changed")
    return _plain(
        snapshots.latest_per_key(
            _ethereum(t.delegate_changed), ["delegator"], snapshots.LOG_ORDER
        )
    )


@query
def latest_by_time(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "delegate_changed")
    return _plain(
        snapshots.latest_per_key(t.delegate_changed, ["chain", "delegator"], snapshots.EVENT_ORDER)
    )


@query
def latest_dense_rank(spark, sf_dir):
    """All events of the last block per delegate, ties kept."""
    t = benchmark_tables(spark, sf_dir, "delegate_changed")
    return _plain(
        snapshots.latest_per_key(t.delegate_changed, ["to_delegate"], ["evt_block_number"], ties="all")
    )


@query
def current_delegations(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "delegate_changed")
    return _plain(snapshots.current_delegations(t.delegate_changed, CONFIG.as_of))


@query
def current_delegations_asof(spark, sf_dir):
    """A moment amid the events: later ones don't count."""
    t = benchmark_tables(spark, sf_dir, "delegate_changed")
    return _plain(snapshots.current_delegations(t.delegate_changed, "1998-06-15 02:00:00+02:00"))


@query
def current_delegations_per_chain_tables(spark, sf_dir):
    """One event table per chain."""
    changes = src.delegate_changed(spark, _by_chain(spark, sf_dir, "delegate_changed"))
    return _plain(snapshots.current_delegations(changes, CONFIG.as_of))


@query
def current_delegations_single(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "delegate_changed")
    return _plain(
        snapshots.current_delegations(
            _ethereum(t.delegate_changed), CONFIG.as_of, snapshots.LOG_ORDER, with_time=False
        )
    )


# Moments ahead of most events, amid them, and after the last one.
MOMENTS = {"early": "1992-03-01 00:00:00", "amid": "1998-06-15 00:00:00", "late": CONFIG.as_of}


def _delegations_at(as_of: str) -> Query:
    """From kept intervals: a filtered scan."""

    def run(spark, sf_dir):
        t = benchmark_tables(spark, sf_dir, "delegate_changed")
        kept = pin(history.delegation_intervals(t.delegate_changed), "intervals")
        return _plain(history.delegations_at(kept.df, as_of))

    return run


for _name, _as_of in MOMENTS.items():
    QUERIES[f"delegations_at_{_name}"] = _delegations_at(_as_of)


@query
def delegation_intervals(spark, sf_dir):
    """In log order, where a later block may have an earlier time."""
    t = benchmark_tables(spark, sf_dir, "delegate_changed")
    return _plain(history.delegation_intervals(t.delegate_changed, snapshots.LOG_ORDER, span=100))


@query
def delegators_per_delegate(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "delegate_changed")
    return _plain(snapshots.delegators_per_delegate(_ethereum(t.delegate_changed)))


# Ledger


def _ledger(spark, sf_dir, **options) -> DataFrame:
    t = benchmark_tables(spark, sf_dir, *LEDGER)
    current = snapshots.current_delegations(t.delegate_changed, CONFIG.as_of)
    holders_now = pin(current.select("chain", "delegator"), "delegations")
    moved = t.transfers.where(up_to("evt_block_time", CONFIG.as_of))
    return _plain(ledger.ledger_balances(moved, holders_now, CONFIG.decimals, **options))


@query
def ledger_balances(spark, sf_dir):
    return _ledger(spark, sf_dir)


@query
def ledger_balances_many_holders(spark, sf_dir):
    """The form for holder lists beyond broadcast size."""
    return _ledger(spark, sf_dir, broadcast_rows=0)


@query
def ledger_debits(spark, sf_dir):
    return _ledger(spark, sf_dir, legs=ledger.debits)


@query
def ledger_credits(spark, sf_dir):
    return _ledger(spark, sf_dir, legs=ledger.credits)


def _ledger_at(as_of: str) -> Query:
    """From kept balances at the ends of months, and the transfers of one month."""

    def run(spark, sf_dir):
        t = benchmark_tables(spark, sf_dir, *LEDGER)
        current = snapshots.current_delegations(t.delegate_changed, CONFIG.as_of)
        holders_now = pin(current.select("chain", "delegator"), "delegations")
        kept = pin(history.balance_history(t.transfers), "balance-history")
        return _plain(history.ledger_at(kept.df, t.transfers, holders_now, as_of, CONFIG.decimals))

    return run


for _name, _as_of in MOMENTS.items():
    QUERIES[f"ledger_at_{_name}"] = _ledger_at(_as_of)


@query
def balance_history(spark, sf_dir):
    """Balances of all addresses at the ends of quarters."""
    t = benchmark_tables(spark, sf_dir, "transfers")
    return _plain(history.balance_history(t.transfers, "QUARTER"))


# Leaderboards and figures


def _state(spark, sf_dir, chain=None):
    t = benchmark_tables(spark, sf_dir, *BOARD)
    return t, reports.current_state(t, CONFIG, chain, with_time=chain is None)


def _single(spark, sf_dir, **options) -> DataFrame:
    t, state = _state(spark, sf_dir, "Ethereum")
    return leaderboard.delegator_leaderboard(
        state.holdings, t.address_names, CONFIG.decimals, CONFIG.dust, **options
    )


def _multi(spark, sf_dir, **options) -> DataFrame:
    t, state = _state(spark, sf_dir)
    return leaderboard.delegator_leaderboard_multi(
        state.holdings, t.address_names, CONFIG.decimals, CONFIG.dust, **options
    )


@query
def leaderboard_single(spark, sf_dir):
    return _plain(_single(spark, sf_dir))


@query
def leaderboard_single_distributed(spark, sf_dir):
    """The form for books beyond broadcast size and ranks beyond one task."""
    return _plain(_single(spark, sf_dir, broadcast_rows=0, window_rows=0))


@query
def leaderboard_multi(spark, sf_dir):
    return _plain(_multi(spark, sf_dir))


@query
def leaderboard_multi_distributed(spark, sf_dir):
    return _plain(_multi(spark, sf_dir, broadcast_rows=0, window_rows=0))


@query
def global_rank(spark, sf_dir):
    return _plain(leaderboard.global_rank(_multi(spark, sf_dir)))


@query
def rank_thresholds(spark, sf_dir):
    return metrics.rank_thresholds(_multi(spark, sf_dir), CONFIG.ks)


@query
def rank_thresholds_selected(spark, sf_dir):
    """Without ranks: amounts at rank k found by counting."""
    t, state = _state(spark, sf_dir)
    return leaderboard.thresholds(state.holdings, t.address_names, CONFIG.ks, CONFIG.decimals, CONFIG.dust)


@query
def rank_thresholds_by_chain(spark, sf_dir):
    return metrics.rank_thresholds_wide(_multi(spark, sf_dir), CONFIG.ks, CHAIN_PREFIX)


def _totals(spark, sf_dir, *columns, strict=False) -> DataFrame:
    _, state = _state(spark, sf_dir)
    totals = metrics.chain_totals(state.holdings.df, CONFIG.chains, CONFIG.decimals, strict)
    return totals.select(*columns)


@query
def chain_totals(spark, sf_dir):
    return _totals(spark, sf_dir, "*")


@query
def grand_total(spark, sf_dir):
    return _totals(spark, sf_dir, "total_w_delegated_all")


@query
def grand_total_strict(spark, sf_dir):
    return _totals(spark, sf_dir, "total_w_delegated_all", strict=True)


@query
def unique_delegators_delegations(spark, sf_dir):
    return metrics.unique_delegators(_state(spark, sf_dir)[1].delegations.df)


@query
def unique_delegators_balances(spark, sf_dir):
    return metrics.unique_delegators(_state(spark, sf_dir)[1].holdings.df)


@query
def distinct_stakers(spark, sf_dir):
    return metrics.distinct_stakers(_multi(spark, sf_dir))


@query
def holding_histogram(spark, sf_dir):
    return metrics.holding_histogram(_multi(spark, sf_dir), CONFIG.edges, CONFIG.last_edge_label)


# Voting power


@query
def voting_power_now(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "votes_changed")
    return _plain(snapshots.voting_power_snapshot(t.votes_changed, VOTES_CONFIG.decimals))


@query
def voting_power_asof(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "votes_changed")
    return _plain(
        snapshots.voting_power_snapshot(
            t.votes_changed, VOTES_CONFIG.decimals, VOTES_CONFIG.as_of, VOTES_CONFIG.lookback
        )
    )


def _voting_power_at(as_of: str | None) -> Query:
    """From kept intervals."""

    def run(spark, sf_dir):
        t = benchmark_tables(spark, sf_dir, "votes_changed")
        kept = pin(history.vote_intervals(t.votes_changed, span=500), "vote-intervals")
        return _plain(history.voting_power_at(kept.df, VOTES_CONFIG.decimals, as_of, VOTES_CONFIG.lookback))

    return run


VOTE_MOMENTS = {"early": "2024-01-03 00:00:00", "amid": "2024-01-16 00:00:00", "before": VOTES_CONFIG.as_of, "now": None}
for _name, _as_of in VOTE_MOMENTS.items():
    QUERIES[f"voting_power_at_{_name}"] = _voting_power_at(_as_of)


@query
def voting_power_change(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "votes_changed")
    change = snapshots.voting_power_change(
        t.votes_changed, VOTES_CONFIG.as_of, VOTES_CONFIG.lookback
    )
    return _plain(
        change.select(
            "delegate",
            to_tokens("units", VOTES_CONFIG.decimals).alias("dt_voting_power"),
            to_tokens("prev_units", VOTES_CONFIG.decimals).alias("prev_voting_power"),
        )
    )


def _resolved(spark, sf_dir, **options) -> DataFrame:
    t = benchmark_tables(spark, sf_dir, "votes_changed", "address_names", "ens", "labels")
    power = snapshots.voting_power_change(
        t.votes_changed, VOTES_CONFIG.as_of, VOTES_CONFIG.lookback
    ).where((F.col("units") > 0) & (F.col("delegate") != address(ZERO)))
    wanted = pin(power.select(F.col("delegate").alias("address")), "wanted")
    return _plain(
        labels.resolve_labels(wanted, t.address_names, t.ens, t.labels, **options)
    )


@query
def resolve_labels(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query
def resolve_labels_many(spark, sf_dir):
    """The form for address lists beyond broadcast size."""
    return _resolved(spark, sf_dir, broadcast_rows=0)


@query
def top_n_with_other(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, *VOTES)
    return _plain(reports.merged_delegates(t, VOTES_CONFIG).drop("units", "total_units"))


@query
def delegate_ranking(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, *VOTES)
    ranking = delegates.delegate_ranking(
        reports.merged_delegates(t, VOTES_CONFIG),
        VOTES_CONFIG.top_n,
        VOTES_CONFIG.vote_page,
        VOTES_CONFIG.breakdown_page,
        VOTES_CONFIG.breakdown_caption,
    )
    return _plain(ranking.drop("units", "total_units"))


@query
def concentration(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, *VOTES)
    return reports.top_delegates(t, VOTES_CONFIG).select(
        "delegate",
        "delegate_rank",
        "running_pct_voting_power",
        "running_dt_voting_power",
        "total_voting_power",
        "num_delegates_to_majority",
        "num_delegates_to_quorum",
    )


# Holders


@query
def latest_holdings(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "balances")
    return _plain(holders.latest_holdings(t.balances, TOKEN).drop("units"))


@query
def balance_at_ranks(spark, sf_dir):
    t = benchmark_tables(spark, sf_dir, "balances")
    return holders.balance_at_ranks(pin(holders.latest_holdings(t.balances, TOKEN), "holders"), CONFIG.ks)


@query
def balance_at_ranks_distributed(spark, sf_dir):
    """The form for more holders than one task ranks."""
    t = benchmark_tables(spark, sf_dir, "balances")
    held = pin(holders.latest_holdings(t.balances, TOKEN), "holders")
    return holders.balance_at_ranks(held, CONFIG.ks, window_rows=0)


# Links


@query
def html_links(spark, sf_dir):
    changes = benchmark_tables(spark, sf_dir, "delegate_changed").delegate_changed
    text = to_text("delegator")
    return changes.select(
        "evt_index",
        explorer_url("chain", text, CONFIG.explorers).alias("url"),
        html_link(explorer_url("chain", text, CONFIG.explorers), text).alias("link"),
    )


@query
def short_address(spark, sf_dir):
    names = benchmark_tables(spark, sf_dir, "address_names").address_names
    text = to_text("address")
    blank = F.nullif(F.col("name"), F.lit(""))
    return names.select(
        text.alias("address"),
        short_addr(text).alias("short"),
        delegate_anchor(
            VOTES_CONFIG.vote_page, text, blank, F.nullif(F.col("ens"), F.lit(""))
        ).alias("anchor"),
    )


# Reports


def _single_chain(chain: str) -> Query:
    def run(spark, sf_dir):
        return reports.single_chain_delegators(
            benchmark_tables(spark, sf_dir, *BOARD), chain, CONFIG
        )

    return run


for _chain in CONFIG.chains:
    QUERIES[f"report_single_chain_{_chain.lower()}"] = _single_chain(_chain)


@query
def report_all_chains(spark, sf_dir):
    return reports.all_chain_delegators(benchmark_tables(spark, sf_dir, *BOARD), CONFIG)


@query
def report_ranges(spark, sf_dir):
    return reports.holding_size_ranges(benchmark_tables(spark, sf_dir, *BOARD), CONFIG)


@query
def report_chain_totals(spark, sf_dir):
    return reports.chain_totals_report(benchmark_tables(spark, sf_dir, *BOARD), CONFIG)


@query
def report_thresholds(spark, sf_dir):
    return reports.threshold_report(benchmark_tables(spark, sf_dir, *BOARD), CONFIG)


@query
def report_top_delegates(spark, sf_dir):
    return reports.top_delegates(benchmark_tables(spark, sf_dir, *VOTES), VOTES_CONFIG)


@query
def report_holders(spark, sf_dir):
    return reports.token_holders(
        benchmark_tables(spark, sf_dir, "balances"), TOKEN.upper().replace("X", "x", 1), CONFIG
    )

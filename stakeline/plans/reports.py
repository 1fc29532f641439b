"""The seven delegation reports.

A report keeps its shared intermediate tables (see ``stakeline.scale``) when it is called and
returns a DataFrame whose result the caller may write, collect or query further; ``scale.release``
or a ``scale.scratch`` block then removes them. Pass a ``Config`` with a fixed ``as_of`` to make a
report repeatable: events after it don't count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeline.config import CHAIN_PREFIX, Config, k_label
from stakeline.functions.addresses import ZERO, address, to_text, with_text
from stakeline.functions.amounts import share, to_tokens
from stakeline.functions.links import explorer_url, html_link
from stakeline.functions.times import dated, moment, up_to
from stakeline.operators import delegates, history, holders, labels, leaderboard, ledger, metrics, snapshots
from stakeline.scale import Sized, keep, pin, with_row
from stakeline.sources.tables import Tables


@dataclass(frozen=True)
class State:
    """Current delegations and ledger holdings, stored once per report."""

    delegations: Sized
    holdings: Sized


def current_state(
    tables: Tables, cfg: Config, chain: str | None = None, with_time: bool = True
) -> State:
    """Read the events once, keep one row per (chain, delegator), and net their transfers.

    Over all chains, kept intervals and balances stand in for the events where ``tables`` has them.
    """
    wanted = F.col("chain").isin(*cfg.chains) if chain is None else F.col("chain") == chain
    if chain is None and tables.delegation_intervals is not None:
        current = history.delegations_at(tables.delegation_intervals.where(wanted), cfg.as_of, with_time)
    else:
        order = snapshots.EVENT_ORDER if chain is None else snapshots.LOG_ORDER
        changes = tables.delegate_changed.where(wanted)
        current = snapshots.current_delegations(changes, cfg.as_of, order, with_time, cfg.backdated)
    delegations = pin(current.drop("evt_block_time"), "delegations")
    transfers = tables.transfers.where(wanted)
    if tables.balance_history is not None:
        balances = tables.balance_history.where(wanted)
        holdings = history.ledger_at(balances, transfers, delegations, cfg.as_of, cfg.decimals, cfg.history_period)
    else:
        holdings = ledger.ledger_balances(_moved_by(transfers, cfg), delegations, cfg.decimals)
    return State(delegations, pin(holdings.drop("w_delegated"), "holdings"))


class Shared:
    """What several reports over all chains have in common, worked out once, when it is first needed.

    Pass one to ``all_chain_delegators``, ``holding_size_ranges``, ``chain_totals_report`` and
    ``threshold_report``: together they read the events once, look up names once and rank once. The
    reports of single chains order events by their log position, which may pick other delegations,
    so they have a state of their own.
    """

    def __init__(self, tables: Tables, cfg: Config = Config()):
        self.tables, self.cfg = tables, cfg.at()

    @cached_property
    def state(self) -> State:
        return current_state(self.tables, self.cfg)

    @cached_property
    def ranked(self) -> DataFrame:
        return leaderboard.ranked_delegators(self.state.holdings, self.tables.address_names)


def _moved_by(transfers: DataFrame, cfg: Config) -> DataFrame:
    """Transfers up to ``as_of``. Without their times only the present can be described."""
    if not cfg.backdated:
        return transfers
    if "evt_block_time" not in transfers.columns:
        transfers = transfers.withColumn("evt_block_time", F.lit(None).cast("timestamp_ntz"))
    return dated(transfers.where(up_to("evt_block_time", cfg.as_of)), "a transfer")


def _links(cfg: Config) -> dict[str, Column]:
    delegator, delegate = to_text("delegator"), to_text("delegate_address")
    return {
        "delegator_address": delegator,
        "delegator_address_link": html_link(
            explorer_url("chain", delegator, cfg.explorers), delegator
        ),
        "delegator_name": F.lit(None).cast("string"),
        "delegate_address_link": html_link(F.concat(F.lit(cfg.delegate_page), delegate), delegate),
        "delegate_address": delegate,
        "last_refresh": moment(cfg.as_of),
        "blockchain": F.col("chain"),
    }


def _report(
    board: DataFrame,
    cfg: Config,
    columns: list[str],
    per_chain: Sequence[DataFrame] = (),
    one_row: Sequence[DataFrame] = (),
) -> DataFrame:
    """Sort as the report does, then append repeated figures and links to the sorted rows.

    ``per_chain`` frames have one row per chain, ``one_row`` frames a single row. Appending them
    after the sort keeps its shuffle narrow; broadcast joins keep the order (there are few chains).
    """
    out = board.orderBy("rank", F.col("units").desc(), "chain", "delegator", "delegate_name")
    for figures in per_chain:
        figures = figures.withColumnRenamed("chain", "_chain")
        out = out.join(figures, F.col("chain").eqNullSafe(F.col("_chain")), "left").drop("_chain")
    for figures in one_row:
        out = with_row(out, figures)
    links = _links(cfg)
    return out.select(*[links[c].alias(c) if c in links else c for c in columns])


_DELEGATION = ["w_delegated", "pct_of_delegated", "days_delegated", "delegate_date", "delegate_name"]
_MULTI = [
    "rank",
    "blockchain",
    "delegator_address",
    "delegator_address_link",
    "delegator_name",
    *_DELEGATION,
    "delegate_address_link",
    "delegate_address",
    "last_refresh",
    "total_w_delegated_blockchain",
]


def _thresholds(cfg: Config) -> list[str]:
    return [f"tokens_for_top_{k_label(k)}" for k in cfg.ks]


def single_chain_delegators(tables: Tables, chain: str, cfg: Config = Config()) -> DataFrame:
    """All delegators of one chain by balance."""
    cfg = cfg.at()
    state = current_state(tables, cfg, chain, with_time=False)
    board = leaderboard.delegator_leaderboard(
        state.holdings, tables.address_names, cfg.decimals, cfg.dust
    )
    columns = [
        "rank",
        "delegator_address",
        "delegator_address_link",
        "delegator_name",
        *_DELEGATION,
        "delegate_address_link",
        "delegate_address",
        "last_refresh",
        "total_w_delegated",
    ]
    return _report(board, cfg, columns)


@dataclass(frozen=True)
class Board:
    """The ranked list of all chains and what is repeated beside it, read from a few kept rows."""

    rows: DataFrame
    per_chain: DataFrame
    totals: DataFrame
    stakers: DataFrame


def _multi_board(shared: Shared, base: str, strict: bool = False) -> Board:
    """Ranks are kept, and beside them one table of figures with a row per chain.

    ``per_chain`` has the thresholds and unique delegators of a chain, ``totals`` the totals of the
    chains as one row; both are read off the figures. ``base`` says which rows of the state count as
    delegators.
    """
    state, cfg, ranked = shared.state, shared.cfg, shared.ranked
    at = [F.col("rank") == k for k in cfg.ks]
    fields = F.struct("units", "days_delegated")
    listed = ranked.groupBy("chain").agg(
        F.sum("units").alias("chain_units"), *[F.max(F.when(hit, fields)).alias(f"_at_{k}") for hit, k in zip(at, cfg.ks)]
    )
    held = state.holdings.df.groupBy("chain").agg(
        F.sum("units").alias("held_units"), F.count("delegator").alias("unique_delegators")
    )
    parts = [listed, held]
    if base == "delegations":
        parts = [listed, held.drop("unique_delegators"), metrics.unique_delegators(state.delegations.df)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    named = [c for c in rows.columns if c != "chain"]
    rows = rows.groupBy("chain").agg(*[F.first(c, ignorenulls=True).alias(c) for c in named])
    # A row per chain.
    figures = F.broadcast(keep(rows, "figures"))
    units = figures.where("chain_units IS NOT NULL").select("chain", "chain_units")

    def mark(k: int) -> Column:
        reached = F.col(f"_at_{k}")
        tokens = to_tokens(reached["units"], cfg.decimals)
        above = (tokens > cfg.dust) & (share(reached["units"], "chain_units") > cfg.dust) & (reached["days_delegated"] > 0)
        return F.when(above, tokens).alias(f"tokens_for_top_{k_label(k)}")

    shown = leaderboard.with_shares(ranked, units, cfg.decimals, cfg.dust)
    per_chain = figures.select("chain", *[mark(k) for k in cfg.ks], "unique_delegators")
    by_chain = figures.select("chain", F.col("held_units").alias("units"))
    totals = metrics.chain_totals(by_chain, cfg.chains, cfg.decimals, strict)
    return Board(shown, per_chain, totals, metrics.distinct_stakers(shown))


def all_chain_delegators(tables: Tables, cfg: Config = Config(), shared: Shared | None = None) -> DataFrame:
    """Delegators of every chain, ranked per chain, with thresholds, staker count and grand total.

    Tables and parameters are those of ``shared`` if it is given; so they are in the next three.
    """
    shared = shared or Shared(tables, cfg)
    cfg, board = shared.cfg, _multi_board(shared, "holdings")
    columns = [*_MULTI, *_thresholds(cfg), "num_of_stakers", "total_w_delegated_all", "unique_delegators"]
    totals = board.totals.select("total_w_delegated_all")
    return _report(board.rows, cfg, columns, [board.per_chain], [board.stakers, totals])


def holding_size_ranges(tables: Tables, cfg: Config = Config(), shared: Shared | None = None) -> DataFrame:
    """Number of (chain, delegator) rows per holding size."""
    shared = shared or Shared(tables, cfg)
    cfg, holdings = shared.cfg, shared.state.holdings
    listed = leaderboard.listed_delegators(holdings, shared.tables.address_names)
    rows = leaderboard.with_shares(listed, leaderboard.chain_units(listed), cfg.decimals, cfg.dust)
    return metrics.holding_histogram(rows, cfg.edges, cfg.last_edge_label)


def chain_totals_report(tables: Tables, cfg: Config = Config(), shared: Shared | None = None) -> DataFrame:
    """``all_chain_delegators`` with the total of each chain as a column."""
    shared = shared or Shared(tables, cfg)
    cfg, board = shared.cfg, _multi_board(shared, "holdings")
    chain_columns = [c for c in board.totals.columns if c != "total_w_delegated_all"]
    columns = [
        *_MULTI,
        *_thresholds(cfg),
        "num_of_stakers",
        *chain_columns,
        "unique_delegators",
        "total_w_delegated_all",
    ]
    return _report(board.rows, cfg, columns, [board.per_chain], [board.stakers, board.totals])


def threshold_report(tables: Tables, cfg: Config = Config(), shared: Shared | None = None) -> DataFrame:
    """Delegators of every chain with per-chain totals and the tokens held at rank k of each chain.

    Unique delegators are counted over current delegations, and the grand total is NULL if any
    chain has no balance.
    """
    shared = shared or Shared(tables, cfg)
    cfg, board = shared.cfg, _multi_board(shared, "delegations", strict=True)
    prefixes = {c: CHAIN_PREFIX.get(c, c.lower()) for c in cfg.chains}
    wide = metrics.wide_thresholds(board.per_chain, cfg.ks, prefixes)
    columns = [
        "rank",
        "blockchain",
        "delegator_address_link",
        *_DELEGATION,
        "delegate_address_link",
        "last_refresh",
        "total_w_delegated_blockchain",
        *_thresholds(cfg),
        *board.totals.columns,
        "unique_delegators",
        *wide.columns,
    ]
    return _report(board.rows, cfg, columns, [board.per_chain], [board.totals, wide])


def delegate_power(tables: Tables, cfg: Config) -> Sized:
    """Base units per delegate now and before the lookback, the zero address left out; stored."""
    votes = tables.votes_changed.where(
        (F.col("chain") == cfg.votes_chain) & (F.col("delegate") != address(ZERO))
    )
    return pin(snapshots.voting_power_change(votes, cfg.as_of, cfg.lookback, cfg.backdated), "power")


def merged_delegates(tables: Tables, cfg: Config) -> DataFrame:
    """Top delegates with their labels, and the collapsed rest: at most 2 * top_n + 1 rows."""
    power = delegate_power(tables, cfg)
    top = delegates.top_delegates(power, cfg.top_n)
    powered = top.where("units > 0").select(F.col("delegate").alias("address"))
    named = labels.resolve_labels(
        Sized(powered, 2 * cfg.top_n), tables.address_names, tables.ens, tables.labels, cfg.label_category
    )
    named = keep(named, "labels")
    changes = tables.delegate_changed.where(F.col("chain") == cfg.votes_chain)
    changes = changes.where(up_to("evt_block_time", cfg.as_of))
    if cfg.backdated:
        changes = dated(changes, "a delegation")
    counts = snapshots.delegators_per_delegate(changes)
    return delegates.top_n_with_other(power.df, top, counts, named, cfg.decimals)


def top_delegates(tables: Tables, cfg: Config = Config()) -> DataFrame:
    """Top delegates by voting power, their change, delegators, running share and concentration."""
    cfg = cfg.at()
    ranking = delegates.delegate_ranking(
        merged_delegates(tables, cfg),
        cfg.top_n,
        cfg.vote_page,
        cfg.breakdown_page,
        cfg.breakdown_caption,
    )
    return delegates.concentration(
        delegates.one_per_delegate(ranking), cfg.majority, cfg.quorum, cfg.decimals
    )


def token_holders(tables: Tables, token: Column | str | bytes, cfg: Config = Config()) -> DataFrame:
    """Latest non-zero balance of the token per holder and chain, with totals and thresholds."""
    held = pin(holders.latest_holdings(tables.balances, token), "holders")
    return with_text(holders.holder_snapshot(held, cfg.ks, cfg.decimals))

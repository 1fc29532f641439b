"""Physical plans: what is scanned, pushed down, shuffled and never used."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stakeline import scale
from stakeline.operators import holders, leaderboard, ledger, snapshots
from stakeline.operators.chains import union_chains
from stakeline.plans import reports
from stakeline.scale import Sized
from stakeline.sources import tables as src
from stakeline.sources.benchmark import CONFIG, VOTES_CONFIG, benchmark_tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return benchmark_tables(spark, SF_DIR)


def test_latest_is_cut_before_the_shuffle(tables):
    text = plan(snapshots.current_delegations(tables.delegate_changed, CONFIG.as_of))
    assert text.count("WindowGroupLimit") == 2
    assert text.count("Exchange") == 1
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_both_voting_snapshots_share_one_scan(tables):
    text = plan(snapshots.voting_power_change(tables.votes_changed, "2024-01-31 00:00:00", "1 day"))
    assert text.count("FileScan") == 1
    assert text.index("WindowGroupLimit") < text.rindex("Exchange hashpartitioning") < text.rindex(
        "WindowGroupLimit"
    )


@pytest.mark.parametrize("limit, exchanges", [(10**6, 1), (0, 2)])
def test_ledger_scans_transfers_once(tables, limit, exchanges):
    """The long form aggregates ahead of its shuffle and joins on the same partitioning."""
    held = Sized(tables.delegate_changed.select("chain", "delegator").distinct(), 10)
    held_exchanges = plan(held.df).count("Exchange hashpartitioning")
    text = plan(ledger.ledger_balances(tables.transfers, held, broadcast_rows=limit))
    assert text.count("lineitem.parquet") == 1
    assert "SinglePartition" not in text
    assert text.count("Exchange hashpartitioning") <= exchanges + held_exchanges
    assert "partial_try_sum" in text


def test_scan_reads_only_used_columns(tables):
    text = plan(snapshots.voting_power_change(tables.votes_changed, "2024-01-31 00:00:00", "1 day"))
    assert "event_type" not in text.split("ReadSchema")[1]


def test_token_filter_reaches_the_scan(spark, tmp_path):
    rows = spark.sql(
        "SELECT 'base' AS chain, X'01' AS address, X'b0ff' AS token_address, 1 AS balance_raw,"
        " TIMESTAMP_NTZ'2024-01-01 00:00:00' AS block_time"
    )
    rows.write.parquet(str(tmp_path / "held"))
    held = src.balances(spark, str(tmp_path / "held"))
    text = plan(holders.latest_holdings(held, "0xB0FF"))
    assert "EqualTo(token_address,[B" in text
    assert holders.latest_holdings(held, bytes.fromhex("b0ff")).count() == 1


def test_top_delegates_reads_little(spark, tables):
    """What the report keeps is not computed again: few scans, no sort of all delegates."""
    text = plan(reports.top_delegates(tables, VOTES_CONFIG))
    assert text.count("FileScan") <= 8
    assert "TakeOrdered" not in text


def test_ranges_need_no_ranks(spark, tables, monkeypatch):
    kept = []
    pin = scale.pin
    for module in (scale, reports, leaderboard):
        monkeypatch.setattr(module, "pin", lambda df, name: (kept.append(name), pin(df, name))[1])
    text = plan(reports.holding_size_ranges(tables, CONFIG))
    assert "row_number" not in text
    assert "ranked" not in kept and kept


@pytest.mark.parametrize("report", ["all_chain_delegators", "chain_totals_report", "threshold_report"])
def test_boards_scan_the_ranks_once_or_twice(spark, tables, report):
    """The list, and the distinct stakers where they are shown; the rest is small kept tables."""
    text = plan(getattr(reports, report)(tables, CONFIG))
    assert len(re.findall(r"FileScan.*ranked-", text)) <= (1 if report == "threshold_report" else 2)
    assert "lineitem.parquet" not in text and "orders.parquet" not in text


def test_last_task_of_a_top_list_does_not_grow(spark):
    """Beyond a window's size rows are ranked in slices, not merged from every task."""
    held = spark.range(2000).select(
        F.col("id").cast("decimal(38,0)").alias("units"),
        F.col("id").cast("double").alias("balance"),
        F.col("id").cast("string").alias("address"),
        F.lit("a").alias("chain"),
    )
    out = holders.balance_at_ranks(scale.sized(held.repartition(50)), [1, 700, 5000], window_rows=100)
    assert tuple(out.first()) == (1999.0, 1300.0, None)
    text = plan(out)
    assert "GlobalLimit" not in text and "TakeOrdered" not in text and "Window [row_number" not in text


def test_chain_filter_prunes_the_union(spark, tmp_path):
    frames = {}
    for chain in ("Ethereum", "Base"):
        path = str(tmp_path / chain)
        spark.range(3).select(F.lit("0x" + "0" * 40).alias("address"), "id").write.parquet(path)
        frames[chain] = spark.read.parquet(path)
    text = plan(union_chains(frames).where("chain = 'Base'"))
    assert text.count("FileScan") == 1 and "Union" not in text


def test_reports_never_window_all_rows_in_one_task(spark, tables):
    """One-task windows appear only above the bounded delegate list."""
    cfg = CONFIG
    for df in (
        reports.threshold_report(tables, cfg),
        reports.holding_size_ranges(tables, cfg),
    ):
        for line in plan(df).splitlines():
            assert not re.search(r"Window \[.*windowspecdefinition\(specifiedwindowframe", line)


def test_reading_by_table_name_and_format(spark, tmp_path, tables):
    """Views, CSV, JSON and ORC give the same rows as Parquet."""
    names = spark.createDataFrame(
        [("0x" + "AB" * 20, "Ann", "ann.eth"), ("0x" + "00" * 20, "", "")],
        "address string, name string, ens string",
    )
    names.createOrReplaceTempView("book_view")
    want = sorted(map(tuple, src.address_names(spark, "book_view").collect()))
    for fmt in ("orc", "json", "parquet"):
        path = str(tmp_path / fmt)
        names.write.format(fmt).save(path)
        assert sorted(map(tuple, src.address_names(spark, path, fmt).collect())) == want


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="to_delegate"):
        src.delegate_changed(spark, spark.range(1).select(F.lit("a").alias("chain"), F.lit("0x").alias("delegator")))


def test_zoned_times_become_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql(
            "SELECT 'Base' AS chain, X'01' AS delegate, 1 AS new_votes, 0 AS previous_votes,"
            " 1 AS evt_block_number, 1 AS evt_index, TIMESTAMP'2024-01-01 00:00:00 UTC' AS evt_block_time"
        )
        assert str(src.votes_changed(spark, df).first().evt_block_time) == "2024-01-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_both_hours_of_the_clock_change(spark):
    """05:30 and 06:30 UTC show the same local time where the clock goes back."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql(
            "SELECT 'Base' AS chain, X'01' AS delegate, 1 AS new_votes, 0 AS previous_votes, 1 AS evt_block_number,"
            " hour AS evt_index, timestamp_seconds(1730611800 + 3600 * hour) AS evt_block_time"
            " FROM VALUES (0), (1) AS t(hour)"
        )
        times = sorted(str(r.evt_block_time) for r in src.votes_changed(spark, df).collect())
        assert times == ["2024-11-03 05:30:00", "2024-11-03 06:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_malformed_addresses(spark):
    """Events with one are refused, a name under one matches nothing."""
    bad = spark.sql("SELECT 'Base' AS chain, '0xzz' AS `from`, '0x00' AS `to`, 1 AS value")
    with pytest.raises(PySparkException):
        src.transfers(spark, bad).collect()
    book = spark.sql("SELECT 'vitalik' AS address, 'V' AS name")
    assert src.address_names(spark, book).first().address is None

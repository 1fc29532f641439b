"""The unlimited form of each step gives what the quick form gives, also under skew."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import frames as f
from stakeline import scale
from stakeline.operators import leaderboard, ledger
from stakeline.plans import reports


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_distributed_rank_equals_window(spark, seed):
    """One group holds most rows, values tie."""
    rng = random.Random(seed)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(7)
    order = [F.col("v").desc(), F.col("id")]
    for by in (["g"], []):
        quick = scale.rank_rows(scale.sized(df), by, order)
        wide = scale.rank_rows(scale.sized(df), by, order, window_rows=0)
        assert collected(quick) == collected(wide.select(quick.columns))
        assert wide.count() == 500
        top = scale.top_rows(scale.sized(df), order, 30, window_rows=0)
        assert collected(top.select(quick.columns)) == collected(scale.top_rows(scale.sized(df), order, 30).select(quick.columns))


def test_distributed_rank_uses_several_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").alias("v"))
        out = scale.rank_rows(scale.sized(df), ["g"], [F.col("v").desc()], window_rows=0)
        assert out.where("rank <> 1000 - v").count() == 0
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [row_number" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot_rows", [1, 10, 1000])
def test_sliced_lookup_equals_left_join(spark, hot_rows):
    """Key 0 holds two thirds of the left rows; keys repeat on the right; NULL and unknown keys stay."""
    left = spark.createDataFrame(
        [(i, 0 if i % 3 else (None if i % 2 else i)) for i in range(120)], "id int, k int"
    )
    right = spark.createDataFrame(
        [(0, "a"), (0, "b"), (3, "c"), (9, "d"), (9, "d"), (None, "e")], "k int, name string"
    )
    plain = left.join(right, "k", "left").select("id", "k", "name")
    sliced = scale.left_lookup(scale.sized(left), right, "k", broadcast_rows=0, hot_rows=hot_rows)
    assert collected(sliced.df.select("id", "k", "name")) == collected(plain)
    assert sliced.rows == plain.count()
    quick = scale.left_lookup(scale.sized(left), right, "k")
    assert collected(quick.df.select("id", "k", "name")) == collected(plain)
    assert quick.rows >= plain.count()


def test_lookup_in_an_empty_table(spark):
    left = spark.createDataFrame([(1, 1)], "id int, k int")
    right = spark.createDataFrame([], "k int, name string")
    out = scale.left_lookup(scale.sized(left), right, "k")
    assert (out.rows, out.df.first().name) == (1, None)


@pytest.mark.parametrize("seed", range(2))
def test_ledger_equals_branch_by_branch(spark, seed):
    """Both forms of the one-pass ledger against a UNION ALL of one branch per chain and side."""
    rng = random.Random(seed)
    chains = ["Ethereum", "Base"]
    moves = f.transfers(
        spark,
        [
            (rng.choice(chains), rng.choice([0, 0, rng.randrange(30)]), rng.randrange(30), rng.randrange(10**20))
            for _ in range(300)
        ],
    ).cache()
    held = spark.createDataFrame(
        [(c, f.raw(k)) for c in chains for k in rng.sample(range(40), 20)], "chain string, delegator binary"
    ).cache()
    parts = []
    for chain in chains:
        for side, sign in (("from", -1), ("to", 1)):
            parts.append(
                moves.where(F.col("chain") == chain)
                .join(held.where(F.col("chain") == chain), (F.col(f"`{side}`") == F.col("delegator")))
                .groupBy("delegator")
                .agg((F.sum("value") * sign).cast("decimal(38,0)").alias("units"))
                .select(F.lit(chain).alias("chain"), "delegator", "units")
            )
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    want = collected(union.groupBy("chain", "delegator").agg(F.sum("units").alias("units")))
    for limit in (0, 4, 1000):
        for wanted in (held, held.withColumn("since", F.lit(1))):
            have = ledger.ledger_balances(moves, scale.sized(wanted), broadcast_rows=limit)
            assert set(have.columns) == {*wanted.columns, "units", "w_delegated"}
            assert collected(have.select("chain", "delegator", "units")) == want


def test_everyone_holding_sums_to_zero(spark):
    rng = random.Random(5)
    moves = f.transfers(
        spark, [("Base", rng.randrange(9), rng.randrange(9), rng.randrange(10**30)) for _ in range(200)]
    )
    everyone = spark.createDataFrame([("Base", f.raw(k)) for k in range(9)], "chain string, delegator binary")
    out = ledger.ledger_balances(moves, scale.sized(everyone))
    assert out.agg(F.sum("units")).first()[0] == 0


def test_leaderboard_invariants(spark):
    rng = random.Random(7)
    t = f.delegating(
        spark,
        [(rng.choice(["Ethereum", "Base"]), k, rng.randrange(1, 2000), rng.randrange(1, 20)) for k in range(1, 200)],
    )
    state = reports.current_state(t, f.CFG)
    board = leaderboard.delegator_leaderboard_multi(state.holdings, t.address_names, 0).cache()
    shares = board.groupBy("chain").agg(F.sum("pct_of_delegated").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)
    histogram = reports.holding_size_ranges(t, f.CFG)
    assert histogram.agg(F.sum("num_of_stakers")).first()[0] == board.count()
    row = reports.threshold_report(t, f.CFG).first()
    assert row.eth_top_1 >= row.eth_top_2 >= row.eth_top_3


def test_work_dir_is_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert scale.work_dir(spark) == configured
    app = spark.sparkContext.applicationId
    pinned = scale.pin(spark.range(5), "five")
    assert pinned.rows == 5
    assert all(path.startswith(f"file://{configured}/stakeline/{app}/five-") for path in pinned.df.inputFiles())


def test_nothing_is_left_behind(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"), "stakeline", spark.sparkContext.applicationId)
    before = set(folder.iterdir()) if folder.exists() else set()
    with scale.scratch(spark):
        t = f.delegating(spark, [("Ethereum", 1, 60, 3)])
        assert reports.all_chain_delegators(t, f.CFG).count() == 1
        assert set(folder.iterdir()) - before
    assert set(folder.iterdir()) == before


def test_without_a_shared_folder_tables_are_persisted(spark, monkeypatch):
    monkeypatch.setattr(scale, "work_dir", lambda spark: None)
    had = spark.sparkContext.getCheckpointDir()
    with scale.scratch(spark):
        kept = scale.pin(spark.range(7), "seven")
        assert kept.rows == 7 and kept.df.storageLevel.useDisk
    assert not kept.df.storageLevel.useDisk
    assert spark.sparkContext.getCheckpointDir() == had

"""Running state equals the batch operators, whatever the order of arrival."""

import pytest
from pyspark.sql import functions as F

from stakeline.operators import ledger, snapshots
from stakeline.sources.benchmark import CONFIG, benchmark_tables
from stakeline.streaming.state import keep, running_delegations, running_ledger

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    """The rows of a table as a stream of small files in shuffled order."""

    def make(df, name):
        path = str(tmp_path / name)
        df.repartition(3).write.parquet(path)
        return (
            spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path),
            str(tmp_path / f"{name}-state"),
        )

    return make


def drain(state, checkpoint):
    """Final row per (chain, delegator) after all batches."""
    rows = {}
    batches = []

    def upsert(batch, batch_id):
        batches.append(batch_id)
        for r in batch.collect():
            rows[(r[0], bytes(r[1]))] = tuple(r[2:])

    keep(state, upsert, checkpoint).awaitTermination()
    assert len(batches) == 3
    return rows


def test_running_delegations(spark, stream):
    changes = benchmark_tables(spark, SF_DIR, "delegate_changed").delegate_changed
    live, checkpoint = stream(changes, "changes")
    have = drain(running_delegations(live), checkpoint)
    now = snapshots.current_delegations(changes, CONFIG.as_of)
    want = {(r.chain, bytes(r.delegator)): (r.to_delegate, r.evt_block_time) for r in now.collect()}
    assert have == want


def test_running_ledger(spark, stream):
    moves = benchmark_tables(spark, SF_DIR, "transfers").transfers
    live, checkpoint = stream(moves, "moves")
    have = drain(running_ledger(live), checkpoint)
    net = ledger.signed_legs(moves).groupBy("chain", "delegator").agg(F.sum("units"))
    assert have == {(r[0], bytes(r[1])): (r[2],) for r in net.collect()}

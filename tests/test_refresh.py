"""Bursts of changes in processing time, and the ledger at a trigger interval."""

import time

import frames
from quorumbook.plans.workspace import fresh_path
from quorumbook.sources.tables import follow_table
from quorumbook.streaming.ledger import COMMANDS, command_stream, start_ledger
from quorumbook.streaming.refresh import refreshes


def wait_for(query, done, seconds=90):
    end = time.time() + seconds
    while not done() and time.time() < end:
        assert query.exception() is None, query.exception()
        time.sleep(0.2)
    assert done()


def test_three_bursts_give_three_refreshes(spark):
    folder, root = fresh_path(spark, "bursts"), fresh_path(spark, "refreshes")
    change = spark.createDataFrame([("proposals",), ("proposals",), (None,)], "source string").coalesce(1)
    change.limit(0).write.parquet(folder)
    stream = refreshes(follow_table(spark, folder, change.schema), quiet_millis=1500)
    query = stream.writeStream.format("parquet").option("path", f"{root}/rows").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(processingTime="100 milliseconds").start()
    try:
        def rows():
            try:
                return spark.read.schema(stream.schema).parquet(f"{root}/rows").collect()
            except Exception:  # nothing has been written yet
                return []
        for burst in range(3):
            for _ in range(3):
                change.write.mode("append").parquet(folder)
            wait_for(query, lambda: len(rows()) > burst)
        time.sleep(3)
        assert [(r.source, r.changes) for r in sorted(rows(), key=lambda r: r.quiet_since)] == [("proposals", 6)] * 3
    finally:
        query.stop()


def test_ledger_at_a_trigger_interval(spark):
    case = dict(proposer=1, target=2, kind="penalty", amount=1, needed=2, created=0, deadline=120)
    commands = command_stream(
        frames.proposals(spark, {1: case, 2: dict(case, created=300, deadline=420)}),
        frames.votes(spark, [(1, 1, 3, 50), (2, 1, 4, 100)]), frames.withdrawals(spark, []))
    folder = fresh_path(spark, "interval")
    commands.where("proposal_id = 1").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(COMMANDS).parquet(folder)
    query, ledger = start_ledger(stream, frames.players(spark, 9, set(range(9))), fresh_path(spark, "ledger"),
                                 every="300 milliseconds")
    try:
        wait_for(query, lambda: query.lastProgress is not None and query.lastProgress["batchId"] >= 0)
        commands.where("proposal_id = 2").coalesce(1).write.mode("append").parquet(folder)
        wait_for(query, lambda: query.lastProgress["batchId"] >= 1)
        assert [(r.id, r.status, r.approved_by) for r in ledger.outcomes().collect()] == [(1, "approved", 4)]
    finally:
        query.stop()

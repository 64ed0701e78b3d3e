"""Streams over several files against the batch operators."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import frames
import model
from quorumbook.catalog import queries
from quorumbook.operators import ballots, scores, throttle
from quorumbook.operators.status import with_derived_status
from quorumbook.plans.workspace import fresh_path
from quorumbook.sources import schemas
from quorumbook.sources.tables import follow_table
from quorumbook.streaming.ledger import (
    COMMANDS, LedgerFolder, _ledger_batch, close_ledger, command_stream, start_ledger, stream_board,
)
from quorumbook.streaming import matching
from quorumbook.streaming.matching import match_votes, remaining_matches
from quorumbook.streaming.sinks import drain
from quorumbook.streaming.throttle import judge_attempts, stream_throttle


def write_slices(df, folder, edges, column="created_at"):
    """One file per slice of time, so that each becomes a micro-batch."""
    for low, high in zip(edges[:-1], edges[1:]):
        part = df.where((F.col(column) >= F.lit(model.at(low))) & (F.col(column) < F.lit(model.at(high))))
        part.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def ledger(spark):
    proposals, votes, gone, active, n = model.random_log(7, hot="hot")
    tables = (frames.proposals(spark, proposals), frames.votes(spark, votes), frames.withdrawals(spark, gone),
              frames.players(spark, n, active))
    root = fresh_path(spark, "stream-test")
    edges = [-100, 60, 150, 151, 300, 900]
    for name, df in zip(("proposals", "votes", "withdrawals"), tables):
        write_slices(df, f"{root}/{name}", edges)
    return root, tables, len(edges) - 1


def feed(spark, root, name, schema, per_trigger=1):
    return follow_table(spark, f"{root}/{name}", schema, files_per_trigger=per_trigger)


def test_ledger_stream_equals_batch(spark, ledger):
    root, tables, slices = ledger
    commands = command_stream(
        feed(spark, root, "proposals", tables[0].schema), feed(spark, root, "votes", tables[1].schema),
        feed(spark, root, "withdrawals", tables[2].schema))
    query, folder = start_ledger(commands, tables[3], fresh_path(spark, "ledger-test"))
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert last >= slices - 1
    end = F.lit(tables[0].select(F.col("created_at")).union(tables[1].select("created_at"))
                .union(tables[2].select("created_at")).agg(F.max("created_at")).first()[0])
    status = with_derived_status(ballots.resolve_proposals(*tables, end), end)
    columns = ["id", "status", "vote_count", "approved_by", "approved_at"]
    want = sorted(map(str, status.where("status <> 'open'").select(*columns).collect()))
    assert sorted(map(str, folder.outcomes().select(*columns).collect())) == want
    assert folder.outcomes().groupBy("id").count().where("count > 1").isEmpty()
    events = scores.score_events(status)
    assert sorted(map(str, folder.events().collect())) == sorted(map(str, events.collect()))
    board = scores.leaderboard(tables[3], scores.player_totals(events))
    assert sorted(map(str, stream_board(folder, tables[3], last).collect())) == sorted(map(str, board.collect()))
    assert folder.rejects().where("reason = 'late'").isEmpty()


def test_late_commands_are_rejected(spark):
    root = fresh_path(spark, "late-test")
    case = dict(proposer=1, target=2, kind="penalty", amount=1, needed=2, created=0, deadline=120)
    frames.proposals(spark, {1: case}).coalesce(1).write.parquet(f"{root}/proposals")
    gone = frames.withdrawals(spark, [])
    gone.coalesce(1).write.parquet(f"{root}/withdrawals")
    votes = frames.votes(spark, [(1, 1, 3, 50), (2, 1, 4, 100)])
    votes.where("id = 2").coalesce(1).write.parquet(f"{root}/votes")
    players = frames.players(spark, 9, set(range(9)))
    out = fresh_path(spark, "late-ledger")

    def run():
        query, folder = start_ledger(command_stream(
            feed(spark, root, "proposals", frames.PROPOSALS, None), feed(spark, root, "votes", votes.schema, None),
            feed(spark, root, "withdrawals", gone.schema, None)), players, out)
        query.awaitTermination()
        return folder

    run()
    votes.where("id = 1").coalesce(1).write.mode("append").parquet(f"{root}/votes")
    folder = run()  # continues from the checkpoint
    assert [(r["id"], r["reason"]) for r in folder.rejects().collect()] == [(1, "late")]


def test_a_batch_run_again_overwrites_its_output(spark, ledger):
    _, (proposals, votes, gone, players), _ = ledger
    commands = command_stream(proposals, votes, gone)
    folder = LedgerFolder(spark, fresh_path(spark, "again"))
    run = _ledger_batch(folder, players, 0)
    middle = F.lit(model.at(200))
    seen = []
    for batch in (0, 0, 1, 1):
        part = commands.where(F.col("created_at") <= middle if batch == 0 else F.col("created_at") > middle)
        run(part, batch)
        seen.append((sorted(map(str, folder.outcomes().collect())),
                     sorted(map(str, stream_board(folder, players, batch).collect()))))
    assert seen[0] == seen[1] and seen[2] == seen[3]
    assert len(seen[2][0]) > len(seen[0][0])


def test_throttle_stream_equals_batch(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(4), seq, model.at(seq * 40), rng.random() > 0.1, rng.random() < 0.06) for seq in range(300)]
    attempts = spark.createDataFrame(
        rows, "device_id bigint, seq bigint, ts timestamp, format_ok boolean, code_ok boolean"
    ).withColumn("player_id", F.lit(0).cast("bigint"))
    folder = fresh_path(spark, "attempts")
    write_slices(attempts, folder, [0, 3000, 6000, 20000], "ts")
    stream = follow_table(spark, folder, schemas.CLAIM_ATTEMPTS, files_per_trigger=1)
    got = {r["seq"]: r["outcome"] for r in drain(stream_throttle(stream), "throttle-test").collect()}
    want = {r["seq"]: r["outcome"] for r in throttle.claim_throttle(attempts).collect()}
    assert got == want


def test_late_attempts_are_rejected_with_a_reason(spark):
    folder = fresh_path(spark, "late-attempts")
    root = fresh_path(spark, "late-throttle")
    for seq, device, minute in ((1, 1, 0), (2, 1, 100), (3, 2, 200), (4, 1, 50), (5, 1, 201), (6, 1, None)):
        one = spark.createDataFrame(
            [(device, seq, None if minute is None else model.at(minute * 60), True, False, 0)],
            "device_id bigint, seq bigint, ts timestamp, format_ok boolean, code_ok boolean, player_id bigint")
        one.write.mode("append").parquet(folder)
        rows = drain(judge_attempts(follow_table(spark, folder, schemas.CLAIM_ATTEMPTS)), "late", root).collect()
    assert sorted((r["seq"], r["outcome"], r["attempts_left"], r["reason"]) for r in rows) == [
        (1, "invalid_code", 4, None), (2, "invalid_code", 4, None), (3, "invalid_code", 4, None), (4, None, None, "late"),
        (5, "invalid_code", 4, None), (6, None, None, "no_time")]


def test_neighbouring_devices_share_state(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice([None, *range(-2, 9)]), seq, model.at(seq * 40), rng.random() > 0.1, rng.random() < 0.06) for seq in range(300)]
    attempts = spark.createDataFrame(
        rows, "device_id bigint, seq bigint, ts timestamp, format_ok boolean, code_ok boolean"
    ).withColumn("player_id", F.lit(0).cast("bigint"))
    folder, root = fresh_path(spark, "attempts"), fresh_path(spark, "shared-throttle")
    write_slices(attempts, folder, [0, 3000, 6000, 20000], "ts")
    stream = follow_table(spark, folder, schemas.CLAIM_ATTEMPTS, files_per_trigger=1)
    got = drain(judge_attempts(stream, neighbours=4), "throttle-test", root).collect()
    known = {r["seq"]: r["device_id"] for r in attempts.collect()}
    want = {r["seq"]: (r["device_id"], r["outcome"]) for r in throttle.claim_throttle(
        attempts.withColumn("device_id", F.coalesce("device_id", F.lit(99)))).collect()}
    assert {r["seq"]: (r["device_id"], r["outcome"]) for r in got} == {i: (known[i], o) for i, (_, o) in want.items()}
    left = spark.read.format("statestore").option("stateVarName", "throttle").load(f"{root}/checkpoint").collect()
    assert left and {(r.key.device_id or 0) % 4 for r in left} == {0}


def test_vote_match_over_files(spark, ledger):
    root, tables, _ = ledger
    matched = match_votes(feed(spark, root, "proposals", tables[0].schema), feed(spark, root, "votes", tables[1].schema))
    rows = drain(matched, "match-test")
    p, v = tables[0], tables[1]
    want = v.join(p, (v.proposal_id == p.id) & v.created_at.between(p.created_at, p.deadline)).count()
    assert rows.where("matched").count() == want
    everything = rows.unionByName(remaining_matches(rows, p, v))
    assert sorted(r.id for r in everything.collect()) == sorted(r.id for r in v.collect())
    assert everything.where("matched").count() == want


def test_votes_are_matched_with_neighbours_in_any_order(spark):
    case = dict(proposer=1, target=2, kind="penalty", amount=1, needed=2, created=0, deadline=120)
    made = frames.proposals(spark, {i: dict(case, created=10 * i, deadline=10 * i + 120) for i in range(40)})
    made = made.unionByName(made.where("id = 3"))  # an id twice: its votes match both rows
    votes = frames.votes(spark, [(k, None if k % 41 == 0 else k % 45, k % 7, (k % 45) * 10 + k * 7 % 200 - 20)
                                 for k in range(600)])
    root = fresh_path(spark, "match-any-order")
    for k, part in enumerate((made.where("id < 20"), made.where("id >= 20"))):
        part.coalesce(1).write.mode("append").parquet(f"{root}/made")
    for part in (votes.where("created_at < timestamp'2026-01-01 00:03:20'"), votes.where("created_at >= timestamp'2026-01-01 00:03:20'")):
        part.coalesce(1).write.mode("append").parquet(f"{root}/votes")
    in_time = (votes.proposal_id == made.id) & votes.created_at.between(made.created_at, made.deadline)
    want = sorted((r[0], r[1]) for r in votes.join(made, in_time, "left").select(votes.id, made.id.isNotNull()).collect())
    for neighbours, files in ((1, 1), (16, 1), (16, 10)):
        rows = drain(match_votes(
            follow_table(spark, f"{root}/made", made.schema, files_per_trigger=files),
            follow_table(spark, f"{root}/votes", votes.schema, files_per_trigger=files), neighbours=neighbours), "match")
        assert rows.where("not matched").count() > 100  # most of them while the stream runs
        every = rows.unionByName(remaining_matches(rows, made, votes))
        assert sorted((r.id, r.matched) for r in every.collect()) == want


def test_chunks_of_votes_meet_proposals_that_come_after_them():
    class Held(dict):
        clear = dict.clear
        get = lambda self: dict.get(self, "value")
        update = lambda self, value: self.__setitem__("value", value)

    class Handle:
        getValueState = getMapState = lambda self, *_: Votes() if len(_) == 3 else Held()
        registerTimer = lambda self, at: None

    class Votes(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    def rows(kind, *values):
        packed = np.array([(*v, 0) for v in values], matching._EITHER.dtype)
        return Row(kind=kind, rows=packed.tobytes())

    processor = matching.MatchProcessor(120, at_once=2)
    processor.init(Handle())
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    vote = lambda k, case, at: rows("vote", (case, k, at * 1_000_000, 5, 0, 0))
    came = [vote(1, 1, 50), vote(2, 2, 60), vote(3, 1, 70), rows("propose", (1, 0, 40_000_000, 0, 160_000_000, 2)), vote(4, 1, 300)]
    out = [r for o in processor.handleInputRows((0,), iter(came), clock) for r in matching._OUT.read(o.rows).tolist()]
    assert sorted((r[0], r[6]) for r in out) == [(1, True), (3, True)]
    again = iter([rows("propose", (2, 0, 55_000_000, 0, 175_000_000, 2))])
    out = [r for o in processor.handleInputRows((0,), again, clock) for r in matching._OUT.read(o.rows).tolist()]
    assert [(r[0], r[6]) for r in out] == [(2, True)]
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 300_000)
    out = [r for o in processor.handleExpiredTimer((0,), clock, None) for r in matching._OUT.read(o.rows).tolist()]
    assert [(r[0], r[6]) for r in out] == [(4, False)] and not processor._votes


def small_ledger(spark, batches, closing=True):
    """Run batches of command rows; returns the folder, the players and the last batch."""
    players = frames.players(spark, 12, set(range(12)))
    folder = LedgerFolder(spark, fresh_path(spark, "small-ledger"), compact_every=2)
    run = _ledger_batch(folder, players, 0)
    for batch, commands in enumerate(batches):
        run(commands, batch)
    last = len(batches) - 1
    return folder, players, close_ledger(folder, players, last) if closing else last


def test_events_of_one_instant_keep_their_order(spark):
    """A penalty fails at the very instant at which a pardon of the same player is approved; the penalty comes first."""
    table = {1: dict(proposer=1, target=2, kind="penalty", amount=3, needed=8, created=0, deadline=120),
             2: dict(proposer=3, target=1, kind="pardon", amount=1, needed=1, created=60, deadline=180)}
    votes = [(10, 2, 5, 120)]
    commands = command_stream(frames.proposals(spark, table), frames.votes(spark, votes), frames.withdrawals(spark, []))
    end = frames.votes(spark, [(11, 99, 5, 400)])
    later = command_stream(frames.proposals(spark, {}), end, frames.withdrawals(spark, []))
    folder, players, last = small_ledger(spark, [commands, later])
    totals = {r["id"]: r["total"] for r in stream_board(folder, players, last).collect()}
    assert totals[1] == 2
    assert [(r["player_id"], r["delta"]) for r in folder.events().orderBy("proposal_id").collect()] == [(1, 3), (1, -1)]


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_on_command_instants_gives_the_batch_result(spark, seed):
    import random

    proposals, votes, gone, active, n = model.random_log(20 + seed)
    tables = (frames.proposals(spark, proposals), frames.votes(spark, votes), frames.withdrawals(spark, gone))
    commands = command_stream(*tables).cache()
    instants = sorted({frames.seconds(r[0]) for r in commands.select("created_at").collect()})
    cuts = sorted(random.Random(seed).sample(instants, min(4, len(instants))))
    edges = [instants[0] - 1, *cuts, instants[-1]]
    parts = [commands.where((F.col("created_at") > F.lit(model.at(a))) & (F.col("created_at") <= F.lit(model.at(b))))
             for a, b in zip(edges[:-1], edges[1:]) if a < b]
    players = frames.players(spark, n, active)
    folder = LedgerFolder(spark, fresh_path(spark, "cut-ledger"), compact_every=2)
    for batch, part in enumerate(parts):
        _ledger_batch(folder, players, 0)(part, batch)
    last = close_ledger(folder, players, len(parts) - 1)
    status = with_derived_status(ballots.resolve_proposals(*tables, players, F.lit(model.at(edges[-1]))),
                                 F.lit(model.at(edges[-1])))
    events = scores.score_events(status)
    board = scores.leaderboard(players, scores.player_totals(events))
    assert sorted(map(str, folder.events().collect())) == sorted(map(str, events.collect()))
    assert sorted(map(str, stream_board(folder, players, last).collect())) == sorted(map(str, board.collect()))


def test_commands_without_a_time_are_rejected(spark):
    case = dict(proposer=1, target=2, kind="penalty", amount=1, needed=2, created=0, deadline=120)
    commands = command_stream(frames.proposals(spark, {1: case}), frames.votes(spark, [(1, 1, 3, 50)]),
                              frames.withdrawals(spark, []))
    timeless = commands.where("kind = 'vote'").withColumn("created_at", F.lit(None).cast("timestamp"))
    folder, _, _ = small_ledger(spark, [commands, timeless, timeless])
    assert [(r["id"], r["reason"]) for r in folder.rejects().collect()] == [(1, "no_time")] * 2


def test_time_passes_without_commands(spark):
    case = dict(proposer=1, target=2, kind="penalty", amount=1, needed=2, created=0, deadline=120)
    commands = command_stream(frames.proposals(spark, {1: case}), frames.votes(spark, []), frames.withdrawals(spark, []))
    nothing = spark.createDataFrame([], COMMANDS)
    ticks = spark.createDataFrame([(model.at(121),)], "created_at timestamp")
    idle = command_stream(*(t.limit(0) for t in (frames.proposals(spark, {1: case}), frames.votes(spark, []),
                                                 frames.withdrawals(spark, []))), ticks=ticks)
    folder, _, _ = small_ledger(spark, [commands, nothing], closing=False)
    assert folder.outcomes().isEmpty()
    folder, _, _ = small_ledger(spark, [commands, nothing, idle], closing=False)
    assert [(r["id"], r["status"]) for r in folder.outcomes().collect()] == [(1, "failed")]
    assert folder.rejects().isEmpty()


@pytest.mark.parametrize("per_part", [2, 16])
def test_slices_are_written_once_and_hold_every_row(spark, monkeypatch, per_part):
    monkeypatch.setattr(queries, "SLICES_PER_PART", per_part)
    log = spark.range(500).selectExpr("id", "if(id % 50 = 0, null, timestamp_seconds(id * 7 % 500)) as at")
    stream = queries._delivered(SimpleNamespace(spark=spark), log, "at", "delivered-whole", F.col("id") % 10 == 3)
    seen = []

    def note(rows, batch):
        seen.append([(r.id, r.at) for r in rows.collect()])

    root = fresh_path(spark, "delivered-notes")
    stream.writeStream.foreachBatch(note).option("checkpointLocation", root).trigger(availableNow=True).start().awaitTermination()
    assert sorted(i for rows in seen for i, _ in rows) == list(range(500)) and len(seen) == queries.SLICES + 1
    assert all(i % 10 == 3 for i, _ in seen[-1]) and len(seen[-1]) == 50
    assert {i for i, at in seen[0] if at is None} == set(range(0, 500, 50))
    nothing = queries._delivered(SimpleNamespace(spark=spark), log.limit(0), "at", "delivered-nothing")
    assert drain(nothing, "nothing").isEmpty()


def test_slices_come_in_order_from_as_many_files_as_their_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(queries, "ROWS_PER_FILE", 50)
    log = spark.range(3000).selectExpr("id", "timestamp_seconds(id * 7 % 3000) as at")
    stream = queries._delivered(SimpleNamespace(spark=spark), log, "at", "delivered-test")
    seen = []

    def note(rows, batch):
        rows = rows.select("*", F.input_file_name().alias("file"))
        seen.append(rows.agg(F.count("*"), F.unix_seconds(F.min("at")), F.unix_seconds(F.max("at")),
                             F.count_distinct("file")).first())

    root = fresh_path(spark, "delivered-notes")
    stream.writeStream.foreachBatch(note).option("checkpointLocation", root).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == queries.SLICES and {s[3] for s in seen} == {3000 // queries.SLICES // 50}
    assert all(a[2] < b[1] for a, b in zip(seen[:-1], seen[1:])) and sum(s[0] for s in seen) == 3000

"""Keyed state of proposals, of a change feed and of totals against batch operators and plain replays."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import frames
import model
from quorumbook.operators import ballots, changes, scores
from quorumbook.operators.status import with_derived_status
from quorumbook.plans.workspace import fresh_path
from quorumbook.sources import schemas
from quorumbook.sources.tables import follow_table
from quorumbook.streaming.cases import case_rejects, event_log, follow_cases, outcomes
from quorumbook.streaming.changes import follow_changes
from quorumbook.streaming.ledger import command_stream
from quorumbook.streaming.packed import Layout, packed, unpacked
from quorumbook.streaming.sinks import drain
from quorumbook.streaming import totals as keyed_totals
from quorumbook.streaming.totals import (
    PlayersProcessor, TotalProcessor, follow_histogram, follow_totals, latest_totals, ranked_totals,
)

YEARS = 10**9


def as_text(df):
    return sorted(map(str, df.collect()))


def delivered(spark, parts):
    """A stream with one micro-batch per part."""
    folder = fresh_path(spark, "parts")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return follow_table(spark, folder, parts[0].schema, files_per_trigger=1)


@pytest.fixture(scope="module")
def ledger(spark):
    proposals, votes, gone, active, n = model.random_log(7, hot="hot")
    tables = (frames.proposals(spark, proposals), frames.votes(spark, votes), frames.withdrawals(spark, gone),
              frames.players(spark, n, active))
    commands = command_stream(*tables[:3])
    end = F.lit(commands.agg(F.max("created_at")).first()[0])
    status = with_derived_status(ballots.resolve_proposals(*tables, end), end)
    return tables, commands, status


def between(df, low, high):
    return df.where((F.col("created_at") >= F.lit(model.at(low))) & (F.col("created_at") < F.lit(model.at(high))))


WANTED = ["id", "status", "vote_count", "approved_by", "withdrawn_at", "approved_at"]


def wanted(status):
    return as_text(status.where("status <> 'open'").select(*[
        F.unix_micros(c).alias(c) if c.endswith("_at") else c for c in WANTED]))


@pytest.mark.parametrize("edges", [[-100, 60, 150, 151, 300, 900], [-100, 900]])
def test_state_of_proposals_equals_batch(spark, ledger, edges):
    tables, commands, status = ledger
    log = drain(follow_cases(delivered(spark, [between(commands, a, b) for a, b in zip(edges, edges[1:])]), tables[3]), "cases")
    assert as_text(outcomes(log).select(*WANTED)) == wanted(status)
    assert log.where("change = -1").isEmpty()
    events = event_log(log).selectExpr("player_id", "delta", "timestamp_micros(event_at) as event_at", "proposal_id")
    assert as_text(events) == as_text(scores.score_events(status))


def test_state_is_dropped_after_the_decision(spark, ledger):
    tables, commands, status = ledger
    root = fresh_path(spark, "dropped")
    drain(follow_cases(delivered(spark, [commands]), tables[3]), "cases", root)
    left = spark.read.format("statestore").option("stateVarName", "case").load(f"{root}/checkpoint")
    assert {r.key.proposal_id for r in left.collect()} == {r.id for r in status.where("status = 'open'").collect()}
    known = {r.id for r in status.collect()}
    waiting = spark.read.format("statestore").option("stateVarName", "early").load(f"{root}/checkpoint")
    assert not {r.key.proposal_id for r in waiting.collect()} & known


@pytest.mark.parametrize("seed", [1])
def test_late_commands_correct_outcomes_and_totals(spark, ledger, seed):
    tables, commands, status = ledger
    late = F.pmod(F.xxhash64("kind", "id", F.lit(seed)), F.lit(4)) == 0
    parts = [between(commands, a, b).where(~late) for a, b in ((-100, 100), (100, 200), (200, 900))] + [commands.where(late)]
    log = drain(follow_cases(delivered(spark, parts), tables[3], lateness_seconds=YEARS), "late-cases")
    assert not log.where("change = -1").isEmpty()
    assert as_text(outcomes(log).select(*WANTED)) == wanted(status)
    # The events as given out and taken back, in another cut, in segments of two.
    events = event_log(log)
    parts = [events.where(F.pmod(F.xxhash64("proposal_id", "change"), F.lit(3)) == k) for k in range(3)]
    totals = latest_totals(drain(follow_totals(delivered(spark, parts), 2, 3), "totals"))
    have = {r.player_id: r.total for r in totals.collect()}
    want = {r.player_id: r.total for r in scores.player_totals(scores.score_events(status)).collect()}
    assert {p: t for p, t in have.items() if t} == {p: t for p, t in want.items() if t}


def test_chained_state_gives_the_totals_in_one_query(spark, ledger):
    tables, commands, status = ledger
    late = F.pmod(F.col("id"), F.lit(5)) == 0
    stream = delivered(spark, [commands.where(~late), commands.where(late)])
    events = event_log(follow_cases(stream, tables[3], lateness_seconds=YEARS))
    have = {r.player_id: r.total for r in latest_totals(drain(follow_totals(events), "chained")).collect()}
    want = {r.player_id: r.total for r in scores.player_totals(scores.score_events(status)).collect()}
    assert {p: t for p, t in have.items() if t} == {p: t for p, t in want.items() if t}


def test_ranks_after_every_file(spark, ledger):
    tables, _, status = ledger
    events = scores.score_events(status).withColumn("change", F.lit(1)).withColumn("event_at", F.unix_micros("event_at"))
    source, totals_root, ranks_root = (fresh_path(spark, name) for name in ("events", "totals", "ranks"))
    parts = [events.where(F.pmod(F.xxhash64("proposal_id"), F.lit(3)) == k) for k in range(3)]
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        log = drain(follow_totals(follow_table(spark, source, events.schema)), "totals", totals_root)
        histogram = drain(follow_histogram(
            follow_table(spark, f"{totals_root}/rows", log.schema), tables[3]), "ranks", ranks_root)
        so_far = events.where(F.pmod(F.xxhash64("proposal_id"), F.lit(3)) <= k)
        board = scores.leaderboard(tables[3], scores.player_totals(so_far))
        want = scores.ranked_leaderboard(board)
        got = ranked_totals(log, histogram, tables[3])
        assert as_text(got.select(want.columns)) == as_text(want)


def test_refused_commands_have_a_reason(spark):
    case = dict(proposer=1, target=2, kind="penalty", amount=1, needed=2, created=0, deadline=120)
    other = dict(case, created=200, deadline=320)
    made, none = frames.proposals(spark, {1: case, 2: other}), frames.withdrawals(spark, [])
    votes = frames.votes(spark, [(1, 1, 3, 50), (2, 1, 4, 100), (3, 9, 4, 60), (4, 1, 5, 110)])
    timeless = votes.where("id = 4").withColumn("created_at", F.lit(None).cast("timestamp"))
    commands = command_stream(made, votes.where("id in (1, 3)"), none)
    parts = [between(commands, 0, 150), command_stream(made.where("id = 2"), timeless, none),
             command_stream(made.limit(0), votes.where("id in (2, 4)"), none)]
    log = drain(follow_cases(delivered(spark, parts), frames.players(spark, 9, set(range(9)))), "refused")
    got = {(r.id, r.reason) for r in case_rejects(log).collect()}
    assert got == {(4, "no_time"), (2, "late"), (4, "late"), (3, "no_open_proposal")}
    assert [(r.id, r.status, r.vote_count) for r in outcomes(log).collect()] == [(1, "failed", 1)]


class _Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map(dict):
    getValue, updateValue = dict.get, dict.__setitem__


class _Handle:
    def getValueState(self, *_):
        return _Value()

    def getMapState(self, *_):
        return _Map()


def test_totals_equal_a_plain_fold_in_any_order():
    for seed in range(200):
        rng = random.Random(seed)
        processor = TotalProcessor(rng.choice([1, 2, 5]), rng.choice([1, 3, 100]))
        processor.init(_Handle())
        live, total = [], 0
        for _ in range(6):
            rows = []
            for _ in range(rng.randrange(12)):
                if live and rng.random() < 0.3:
                    rows.append((live.pop(rng.randrange(len(live))), -1))
                else:
                    live.append((rng.randrange(20), rng.randrange(50), rng.choice([-1, 1, 2, 3])))
                    rows.append((live[-1], 1))
            rng.shuffle(rows)
            rows = [Row(change=n, event_at=e[0], proposal_id=e[1], delta=e[2]) for e, n in rows]
            for out in processor.handleInputRows((1,), iter(rows), None):
                total = out.total
            want = 0
            for _, _, delta in sorted(live):
                want = max(want + delta, 0)
            assert total == want


def test_totals_of_neighbours_equal_a_plain_fold_in_any_order():
    for seed in range(100):
        rng = random.Random(seed)
        processor = PlayersProcessor(rng.choice([1, 2, 5]), rng.choice([1, 3, 100]))
        processor.init(_Handle())
        live, shown, versions, players = [], {}, {}, rng.choice([1, 2, 6])
        for _ in range(6):
            rows = []
            for _ in range(rng.randrange(1, 25)):
                if live and rng.random() < 0.35:
                    rows.append((*live.pop(rng.randrange(len(live))), -1))
                else:
                    live.append((rng.randrange(players), rng.randrange(20), rng.randrange(50), rng.choice([-1, 1, 2, 3])))
                    rows.append((*live[-1], 1))
            rng.shuffle(rows)
            packs = [Row(rows=np.array([(*r, 0) for r in rows[i:i + 4]], keyed_totals._CHANGE.dtype).tobytes())
                     for i in range(0, len(rows), 4)]
            for out in processor.handleInputRows((0,), iter(packs), None):
                for player, version, total, previous, nulls in keyed_totals._TOTAL.read(out.rows).tolist():
                    assert version == versions.get(player, 0) + 1
                    assert bool(nulls) == (player not in shown) and (nulls or previous == shown[player] != total)
                    versions[player], shown[player] = version, total
            assert {r[0] for r in rows} <= set(shown)
            for player, total in shown.items():
                want = 0
                for *_, delta in sorted(e for e in live if e[0] == player):
                    want = max(want + delta, 0)
                assert total == want


@pytest.mark.parametrize("page_events, portion_rows", [(2, 3), (1024, 20_000)])
def test_neighbouring_players_share_state(spark, ledger, page_events, portion_rows):
    tables, commands, status = ledger
    late = F.pmod(F.xxhash64("kind", "id"), F.lit(5)) == 0
    stream = delivered(spark, [commands.where(~late), commands.where(late)])
    events = event_log(follow_cases(stream, tables[3], lateness_seconds=YEARS, neighbours=8))
    root = fresh_path(spark, "neighbours")
    log = drain(follow_totals(events, page_events, portion_rows, neighbours=4), "chained", root)
    have = {r.player_id: r.total for r in latest_totals(log).collect()}
    want = {r.player_id: r.total for r in scores.player_totals(scores.score_events(status)).collect()}
    assert {p: t for p, t in have.items() if t} == {p: t for p, t in want.items() if t}
    left = spark.read.format("statestore").option("stateVarName", "players").option("operatorId", 0).load(f"{root}/checkpoint")
    assert {r.key.player_id % 4 for r in left.collect()} == {0}


def replayed(rows, end):
    """The view after a change log, change by change in the order of their numbers."""
    cases, votes = {}, {}
    for r in sorted(rows, key=lambda r: r["lsn"]):
        if r["source"] == "proposals":
            if r["op"] == "delete":
                cases.pop(r["id"], None)
                votes = {i: p for i, p in votes.items() if p != r["id"]}
            else:
                cases[r["id"]] = r
        elif r["op"] == "delete":
            votes.pop(r["id"], None)
        else:
            votes[r["id"]] = r["proposal_id"]
    out = []
    for i, r in cases.items():
        status = r["status"] if r["status"] != "pending" else "failed" if end > r["deadline"] else "open"
        event = (None, None, None)  # the instant in microseconds
        if status == "approved" or status == "failed" and r["proposal_type"] == "penalty":
            event = ((r["target_id"], r["approved_at"]) if status == "approved" else (r["proposed_by"], r["deadline"]))
            event = (event[0], r["amount"] if r["proposal_type"] == "penalty" else -1,
                     int(event[1].timestamp()) * 1_000_000)
        out.append((i, status, sum(p == i for p in votes.values()), *event))
    return sorted(out, key=str)


def random_changes(seed):
    """Proposals made, changed, deleted and made again, and votes cast and taken back; numbers follow time."""
    rng = random.Random(seed)
    rows, lsn, votes = [], 0, 0
    for case in range(12):
        at = rng.randrange(300)
        for _ in range(rng.randrange(1, 6)):
            at += rng.randrange(1, 90)
            op = rng.choice(["insert", "update", "update", "delete"])
            status = rng.choice(["pending", "pending", "approved", "withdrawn"])
            rows.append(dict(source="proposals", op=op, id=case, proposal_id=case, at=at, target_id=rng.randrange(5),
                             proposed_by=rng.randrange(5), amount=rng.randrange(1, 4),
                             proposal_type=rng.choice(["penalty", "pardon"]), status=status,
                             approved_at=model.at(at) if status == "approved" else None, deadline=model.at(at + 120),
                             voter_id=None))
            for _ in range(rng.randrange(4)):
                votes += 1
                voted = at + rng.randrange(60)
                for op, when in (("insert", voted), ("delete", voted + 20))[:rng.choice([1, 1, 2])]:
                    rows.append(dict(source="votes", op=op, id=votes, proposal_id=case, at=when, target_id=None,
                                     proposed_by=None, amount=None, proposal_type=None, status=None, approved_at=None,
                                     deadline=None, voter_id=votes % 7))
    rows.sort(key=lambda r: r["at"])
    for r in rows:
        lsn += 1
        r.update(lsn=lsn, changed_at=model.at(r.pop("at")))
    return rows


@pytest.mark.parametrize("seed", [3])
def test_change_feed_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows = random_changes(seed)
    end = max(r["changed_at"] for r in rows)
    want = replayed(rows, end)

    def frame(part):
        return spark.createDataFrame([tuple(r[n] for n in schemas.CHANGES.names) for r in part], schemas.CHANGES)

    batch = changes.view_after(frame(rows), F.lit(end))
    columns = ["id", "status", "vote_count", "player_id", "delta"]
    batch = batch.select(*columns, F.unix_micros("event_at"))
    assert sorted((tuple(r) for r in batch.collect()), key=str) == want
    twice = rows + rng.sample(rows, 20)
    for parts in ([rows[:40], rows[40:80], rows[80:]], [twice[::3], twice[1::3], twice[2::3]]):
        if parts[0] is not rows:
            rng.shuffle(parts)
        log = drain(follow_changes(delivered(spark, [frame(p) for p in parts])), "changes")
        standing = changes.standing_rows(log).select(*columns, "event_at")
        assert sorted((tuple(r) for r in standing.collect()), key=str) == want
        assert not log.where("change = -1").isEmpty()


@pytest.mark.parametrize("page_votes", [2, 512])
def test_neighbouring_proposals_of_a_change_feed_share_state(spark, page_votes):
    rows = random_changes(3)
    end = max(r["changed_at"] for r in rows)
    twice = rows + random.Random(1).sample(rows, 20)
    for parts in ([rows[:40], rows[40:80], rows[80:]], [twice[2::3], twice[::3], twice[1::3]]):
        parts = [spark.createDataFrame([tuple(r[n] for n in schemas.CHANGES.names) for r in p], schemas.CHANGES) for p in parts]
        root = fresh_path(spark, "neighbours")
        log = drain(follow_changes(delivered(spark, parts), neighbours=8, page_votes=page_votes), "changes", root)
        standing = changes.standing_rows(log).select("id", "status", "vote_count", "player_id", "delta", "event_at")
        assert sorted((tuple(r) for r in standing.collect()), key=str) == replayed(rows, end)
        left = spark.read.format("statestore").option("stateVarName", "case").load(f"{root}/checkpoint").collect()
        assert {r.key.proposal_id % 8 for r in left} == {0}
        pages = spark.read.format("statestore").option("stateVarName", "votes").load(f"{root}/checkpoint").collect()
        held = {r.key.proposal_id: r.value.held for r in left}
        assert sum(held.values()) == sum(len(r.user_map_value.votes) // 32 for r in pages)
        assert len(pages) > len(held) if page_votes == 2 else len(pages) == sum(n > 0 for n in held.values())


def test_changes_without_a_key_and_empty_feeds(spark):
    rows = [dict(r) for r in random_changes(5)[:3]]
    for r in rows[:2]:
        r.update(id=None)
    df = spark.createDataFrame([tuple(r[n] for n in schemas.CHANGES.names) for r in rows], schemas.CHANGES)
    assert changes.view_after(df.where("false"), F.current_timestamp()).collect() == []
    log = drain(follow_changes(delivered(spark, [df.where("id is null")])), "no-keys")
    assert log.collect() == [] and changes.view_after(df.where("id is null"), F.current_timestamp()).collect() == []


@pytest.mark.parametrize("late", [False, True])
def test_neighbouring_proposals_share_state(spark, ledger, late):
    tables, commands, status = ledger
    behind = F.pmod(F.xxhash64("kind", "id"), F.lit(4)) == 0 if late else F.lit(False)
    parts = [between(commands, a, b).where(~behind) for a, b in ((-100, 100), (100, 200), (200, 900))]
    parts += [commands.where(behind)] if late else []
    root = fresh_path(spark, "neighbours")
    log = drain(follow_cases(
        delivered(spark, parts), tables[3], lateness_seconds=YEARS if late else 0, neighbours=8), "cases", root)
    assert as_text(outcomes(log).select(*WANTED)) == wanted(status)
    left = spark.read.format("statestore").option("stateVarName", "case").load(f"{root}/checkpoint")
    assert {r.key.proposal_id % 8 for r in left.collect()} <= {0}


def test_groups_are_powers_of_two(spark, ledger):
    with pytest.raises(ValueError):
        follow_cases(ledger[1], ledger[0][3], neighbours=6)


def test_refused_commands_of_a_group_come_out_as_they_came(spark):
    case = dict(proposer=1, target=2, kind="penalty", amount=1, needed=2, created=0, deadline=120)
    made, none = frames.proposals(spark, {i: case for i in range(5)}), frames.withdrawals(spark, [])
    votes = frames.votes(spark, [(None, 0, None, 50), (2, None, 4, 60), (3, 3, 4, 70), (4, 99, 4, 80)])
    last = frames.withdrawals(spark, [(9, 1, 1, 10_000)])
    parts = [command_stream(made, votes.limit(0), last), command_stream(made.limit(0), votes, none)]
    log = drain(follow_cases(delivered(spark, parts), frames.players(spark, 9, set(range(9))), neighbours=64), "refused")
    got = {(r.kind, r.id, r.proposal_id, r.actor_id, r.reason) for r in case_rejects(log).collect()}
    assert got == {("vote", None, 0, None, "late"), ("vote", 2, None, 4, "late"), ("vote", 3, 3, 4, "late"),
                   ("vote", 4, 99, 4, "late")}
    assert sorted((r.id, r.status, r.vote_count) for r in outcomes(log).collect()) == [(i, "failed", 0) for i in range(5)]


def test_rows_of_a_group_are_one_row_and_come_back(spark):
    layout = Layout("id bigint, amount int, yes boolean")
    df = spark.createDataFrame(
        [(8, "a", 9, 1, True), (8, "a", None, None, None), (8, None, 10, 2, False), (None, "a", 0, 0, False)] * 50,
        "key bigint, kind string, id bigint, amount int, yes boolean").coalesce(1)
    rows = packed(df, layout, "key", "kind")
    assert sorted((str(r.key), str(r.kind)) for r in rows.collect()) == [("8", "None"), ("8", "a"), ("None", "a")]
    back = unpacked(rows, layout, "kind string, id bigint, amount int, yes boolean")
    assert as_text(back) == as_text(df.drop("key"))
    assert packed(df, layout, "key", "kind", portion_rows=1).count() >= 3 and packed(df.limit(0), layout, "key").count() == 0

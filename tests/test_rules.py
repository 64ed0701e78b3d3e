"""Random logs against the one-command-at-a-time model, with and without heavy keys."""

import pytest
from pyspark.sql import functions as F

import frames
import model
from quorumbook.operators import ballots, scores
from quorumbook.operators.status import with_derived_status

AS_OF = 430


@pytest.fixture(scope="module", params=[(1, None, ()), (2, "hot", ()), (3, "hot", (0, 5)), (4, "hot", (0,))],
                ids=["plain", "skewed", "split", "split-one"])
def log(request, spark):
    seed, hot, heavy = request.param
    proposals, votes, gone, active, n = model.random_log(seed, hot=hot)
    tables = (frames.proposals(spark, proposals), frames.votes(spark, votes), frames.withdrawals(spark, gone),
              frames.players(spark, n, active))
    return proposals, tables, heavy, model.replay(proposals, votes, gone, active, AS_OF)


def now():
    return F.lit(model.at(AS_OF))


def test_votes(log):
    _, tables, heavy, (expected, _, _) = log
    rows = ballots.classify_votes(*tables, now(), heavy).collect()
    assert {r["id"]: r["outcome"] for r in rows} == expected
    assert len(rows) == len(expected)
    assert set(expected.values()) >= {"accepted", "already_decided", "past_deadline", "not_eligible", "duplicate",
                                      "no_identity", "not_found"}


def test_withdrawals(log):
    _, tables, heavy, (_, expected, _) = log
    rows = ballots.classify_withdrawals(*tables, now(), heavy).collect()
    assert {r["id"]: r["outcome"] for r in rows} == expected


def test_status_and_totals(log):
    proposals, tables, heavy, (_, _, state) = log
    status = with_derived_status(ballots.resolve_proposals(*tables, now(), heavy), now())
    got = {r["id"]: (r["status"], r["vote_count"], r["approved_by"], frames.seconds(r["approved_at"]))
           for r in status.collect()}
    want = {i: (s["status"], len(s["votes"]), s["by"], s["at"] if s["status"] == "approved" else None)
            for i, s in state.items()}
    assert got == want
    history, last = model.totals(proposals, state)
    events = scores.score_events(status)
    cuts = scores.plan_stretches(events, [0, 1]) if heavy else scores.Stretches()
    assert {r["proposal_id"]: r["total"] for r in scores.score_history(events, cuts).collect()} == history
    assert {r["player_id"]: r["total"] for r in scores.player_totals(events, cuts).collect()} == last


def test_heavy_players_are_cut_from_a_stored_copy(log):
    proposals, tables, heavy, (_, _, state) = log
    status = with_derived_status(ballots.resolve_proposals(*tables, now(), heavy), now())
    events, cuts = scores.prepared_events(status, tables[0], rows_per_task=6)
    assert cuts.players
    assert {r["player_id"]: r["total"] for r in scores.player_totals(events, cuts).collect()} == model.totals(
        proposals, state)[1]


def test_votes_never_exceed_threshold(log):
    _, tables, heavy, _ = log
    resolved = ballots.resolve_proposals(*tables, now(), heavy)
    assert resolved.where("vote_count > required_votes").isEmpty()


def test_input_order_does_not_matter(log):
    _, (proposals, votes, gone, players), heavy, (expected, _, _) = log
    mixed = votes.repartition(7, F.xxhash64("id", F.lit(5))).orderBy(F.desc("id"))
    rows = ballots.classify_votes(proposals.repartition(3), mixed, gone, players, now(), heavy).collect()
    assert {r["id"]: r["outcome"] for r in rows} == expected


@pytest.mark.parametrize("seed", [11, 12])
def test_floored_totals_on_random_sequences(spark, seed):
    import random

    rng = random.Random(seed)
    rows, want = [], {}
    for player in range(30):
        total = 0
        size = 400 if player == 0 else rng.randint(1, 20)
        events = sorted((rng.randrange(30), rng.randrange(10**6), rng.choice([-1, -1, 1, 2, 3])) for _ in range(size))
        for second, key, delta in events:
            total = max(total + delta, 0)
            rows.append((player, delta, model.at(second), key * 100 + player))
        want[player] = total
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "player_id bigint, delta int, event_at timestamp, proposal_id bigint")
    # Four hundred events in thirty instants: instants must be cut by id as well.
    for cuts in (scores.Stretches(), scores.plan_stretches(events, [0, 3])):
        assert {r[0]: r[1] for r in scores.player_totals(events, cuts).collect()} == want
    plain = sorted(map(tuple, scores.score_history(events).collect()))
    cut = sorted(map(tuple, scores.score_history(events, scores.plan_stretches(events, [0])).collect()))
    assert plain == cut

"""Edge cases with known results (FIXTURES.md, section 3)."""

import pytest
from pyspark.sql import functions as F

import frames
import model
from quorumbook.functions import rules, text, timing
from quorumbook.operators import audit, ballots, feeds, players as people, proposals as admission, scores, status as st
from quorumbook.plans.numbering import competition_ranks, numbered


def case(needed=2, amount=1, kind="penalty", created=0, proposer=1, target=2):
    return dict(proposer=proposer, target=target, kind=kind, amount=amount, needed=needed, created=created,
                deadline=created + 120)


def outcome(spark, cases, votes=(), gone=(), as_of=1000, active=range(1, 9)):
    tables = (frames.proposals(spark, cases), frames.votes(spark, list(votes)),
              frames.withdrawals(spark, list(gone)), frames.players(spark, 10, set(active)))
    now = F.lit(model.at(as_of))
    status = st.with_derived_status(ballots.resolve_proposals(*tables, now), now)
    votes = {r["id"]: r["outcome"] for r in ballots.classify_votes(*tables, now).collect()}
    gone = {r["id"]: r["outcome"] for r in ballots.classify_withdrawals(*tables, now).collect()}
    return {r["id"]: r for r in status.collect()}, votes, gone, status, tables[3]


def totals_of(spark, deltas):
    rows = [(1, d, model.at(i), i) for i, d in enumerate(deltas)]
    events = spark.createDataFrame(rows, "player_id bigint, delta int, event_at timestamp, proposal_id bigint")
    return [r["total"] for r in scores.score_history(events).orderBy("event_number").collect()]


def test_g1_g2_pardons_at_zero_are_lost(spark):
    assert totals_of(spark, [1, -1, -1, 2]) == [1, 0, 0, 2]
    assert totals_of(spark, [-1, 3]) == [0, 3]


def test_g3_g5_the_deadline_itself_still_counts(spark):
    status, votes, gone, *_ = outcome(spark, {1: case(), 2: case()}, [(1, 1, 3, 120), (2, 1, 4, 121)], [(1, 2, 1, 120)])
    assert votes == {1: "accepted", 2: "past_deadline"}
    assert gone == {1: "accepted"} and status[2]["status"] == "withdrawn"
    status, *_ = outcome(spark, {1: case()}, as_of=120)
    assert status[1]["status"] == "open"
    status, *_ = outcome(spark, {1: case()}, as_of=121)
    assert status[1]["status"] == "failed"


def test_g6_withdrawal_after_a_vote_is_refused(spark):
    status, _, gone, *_ = outcome(spark, {1: case()}, [(1, 1, 3, 10)], [(1, 1, 1, 11)])
    assert gone == {1: "refused"} and status[1]["status"] == "failed"


def test_g7_g8_who_is_charged_and_listed(spark):
    cases = {1: case(amount=2, needed=4), 2: case(kind="pardon", needed=8, proposer=3, target=4)}
    _, _, _, status, players = outcome(spark, cases)
    events = [(r["player_id"], r["delta"], frames.seconds(r["event_at"]))
              for r in scores.score_events(status).collect()]
    assert events == [(1, 2, 120)]
    history = {r["id"]: (r["affected_id"], r["kind"]) for r in
               feeds.history_feed(feeds.recent_proposals(status), players).collect()}
    assert history == {1: (1, "backfired"), 2: (4, "rejected")}


def test_g9_g10_g11_who_may_vote(spark):
    votes = [(1, 1, 1, 1), (2, 1, 2, 2), (3, 1, 3, 3), (4, 1, 3, 4), (5, 1, 4, 5), (6, 1, 5, 6), (7, 9, 5, 6)]
    status, got, *_ = outcome(spark, {1: case()}, votes)
    assert got == {1: "not_eligible", 2: "not_eligible", 3: "accepted", 4: "duplicate", 5: "accepted",
                   6: "already_decided", 7: "not_found"}
    row = status[1]
    assert (row["status"], row["vote_count"], row["approved_by"]) == ("approved", 2, 4)


def test_votes_without_a_proposal(spark):
    _, got, *_ = outcome(spark, {1: case()}, [(1, None, 3, 1), (2, None, 9, 1), (3, 1, 3, 1)], active=range(1, 5))
    assert got == {1: "not_found", 2: "no_identity", 3: "accepted"}


def test_g12_same_instant_lower_id_first(spark):
    rows = [(1, 1, model.at(5), 8), (1, -1, model.at(5), 7)]
    events = spark.createDataFrame(rows, "player_id bigint, delta int, event_at timestamp, proposal_id bigint")
    assert scores.player_totals(events).first()["total"] == 1


def stored(spark, rows):
    return spark.createDataFrame(rows, "id bigint, target_id bigint, proposed_by bigint, description string, "
                                 "status string, approved_by bigint, approved_at timestamp, withdrawn_at timestamp, "
                                 "created_at timestamp, amount smallint")


def test_g13_g14_legacy_rows(spark):
    rows = [(1, 2, 1, "abc", "approved", 3, model.at(9), None, model.at(0), None),
            (2, 2, 1, "abc", "pending", None, None, None, model.at(0), 2)]
    filled = st.backfill_legacy(stored(spark, rows), F.lit(model.at(500)))
    status = st.status_view(filled, frames.votes(spark, []), F.lit(model.at(500)))
    got = {r["id"]: (r["status"], r["required_votes"], r["vote_count"], r["amount"]) for r in status.collect()}
    assert got == {1: ("approved", 1, 0, 1), 2: ("withdrawn", 4, 0, 2)}
    assert [(r["player_id"], r["delta"]) for r in scores.score_events(status).collect()] == [(2, 1)]
    kinds = {r["id"]: r["kind"] for r in feeds.outcome_labels(status).collect()}
    assert kinds == {1: "adopted_legacy", 2: "withdrawn"}
    assert tuple(st.status_summary(status).first()) == (1, 0)


def board(spark, totals):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(totals)],
                                 "id bigint, display_name string, total int")


def test_g15_g16_competition_rank_and_leaders(spark):
    rows = scores.ranked_leaderboard(board(spark, [("A", 5), ("B", 3), ("C", 5)])).collect()
    assert [(r["rank"], r["display_name"], r["is_leader"]) for r in rows] == [(1, "A", True), (1, "C", True), (3, "B", False)]
    rows = scores.ranked_leaderboard(board(spark, [("A", 0), ("B", 0)])).collect()
    assert [(r["rank"], r["is_leader"]) for r in rows] == [(1, False), (1, False)]


def test_g17_danish_order(spark):
    names = ["Zoe", "Ærø", "Øm", "Åse", "Aage", "Bo"]
    rows = scores.ranked_leaderboard(board(spark, [(n, 1) for n in names])).collect()
    assert [r["display_name"] for r in rows] == ["Bo", "Zoe", "Ærø", "Øm", "Aage", "Åse"]


def test_ranks_across_bands(spark):
    values = [0, 0, 5, 4095, 4096, 4097, 4097, 9000, 2**31 - 1]
    df = spark.createDataFrame([(v,) for v in values], "total int")
    got = {r["total"]: r["rank"] for r in competition_ranks(df, "total").collect()}
    assert got == {v: 1 + sum(w > v for w in values) for v in values}


@pytest.mark.parametrize("rows_per_piece", [10_000, 300, 20])
def test_numbering_in_order(spark, rows_per_piece):
    df = spark.range(0, 5000, 1, 7).selectExpr("id * 7919 % 5003 as key")
    got = [(r["key"], r["row_number"]) for r in numbered(df, "key", rows_per_piece=rows_per_piece).collect()]
    assert sorted(got) == [(k, i + 1) for i, k in enumerate(sorted(k for k, _ in got))]


def commands(spark, rows, schema="id bigint, actor_id bigint, target_id bigint, description string, amount int"):
    return spark.createDataFrame(rows, schema).withColumn("created_at", F.lit(model.at(0)))


def test_g18_text_limits_and_order_of_refusals(spark):
    rows = [(1, 1, 2, " abc ", 1), (2, 1, 2, "x" * 501, 1), (3, 9, 9, "", 0), (4, 1, 1, "", 0), (5, 1, 9, "", 0),
            (6, 1, 2, " ab ", 0), (7, 1, 2, "abc", 0), (8, 1, 2, "abc", 4), (9, 1, 2, "abc", None),
            (10, None, 2, "abc", 1),
            (11, 1, 2, "\tab", 3), (12, 1, 2, "😀😀😀", 2), (13, 1, 2, None, 1)]
    players = frames.players(spark, 9, {1, 2})
    got = {r["id"]: r for r in admission.classify_proposals(commands(spark, rows), players).collect()}
    assert {i: r["outcome"] for i, r in got.items()} == {
        1: "accepted", 2: "bad_description", 3: "no_identity", 4: "self_target", 5: "unknown_target",
        6: "bad_description", 7: "bad_amount", 8: "bad_amount", 9: "bad_amount", 10: "no_identity", 11: "accepted",
        12: "accepted", 13: "bad_description"}
    assert (got[1]["description"], got[1]["required_votes"], frames.seconds(got[1]["deadline"])) == ("abc", 2, 120)
    assert (got[11]["required_votes"], got[12]["required_votes"]) == (8, 4)


def test_default_amount_and_pardon(spark):
    short = "id bigint, actor_id bigint, target_id bigint, description string"
    players = frames.players(spark, 9, {1, 2})
    row = admission.classify_proposals(commands(spark, [(1, 1, 2, "abc")], short), players).first()
    assert (row["outcome"], row["amount"], row["required_votes"]) == ("accepted", 1, 2)
    pardon = commands(spark, [(1, 1, 2, "abc", 3)]).withColumn("proposal_type", F.lit("pardon"))
    row = admission.classify_proposals(pardon, players).first()
    assert (row["amount"], row["required_votes"]) == (1, 8)


def test_accepted_commands_are_appended_and_returned(spark, tmp_path):
    from quorumbook.sources.tables import append_accepted

    players = frames.players(spark, 9, {1, 2})
    classified = admission.classify_proposals(commands(spark, [(1, 1, 2, "abc", 1), (2, 1, 1, "abc", 1)]), players)
    back = append_accepted(classified, str(tmp_path / "proposals"), ["id", "description"])
    assert [r["id"] for r in back.collect()] == [1]
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "proposals")).collect()] == [1]


def test_inline_players_and_views(spark):
    from quorumbook.sources.tables import inline_players
    from quorumbook.sources.views import register_views

    players = inline_players(spark, ["Ann", "Ben", "Cas"]).withColumn("created_at", F.lit(model.at(0)))
    cases = frames.proposals(spark, {1: case(amount=3, needed=8)})
    names = register_views(players, cases, frames.votes(spark, [(1, 1, 3, 5)]), prefix="t_")
    assert names == ["t_players", "t_votes", "t_proposal_status", "t_leaderboard"]
    got = spark.sql("select l.display_name, l.total, s.status, s.vote_count from t_leaderboard l "
                    "join t_proposal_status s on s.proposed_by = l.id").collect()
    assert [tuple(r) for r in got] == [("Ann", 3, "failed", 1)]


def test_numbers_with_a_default(spark):
    df = spark.createDataFrame([("7",), ("0",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.number_or(F.col("t"), 1)).collect()] == [7, 1, 1, 1, 1]


def test_g19_code_format(spark):
    df = spark.createDataFrame([("42",), ("42\n",), (" 42 ",), ("4",), ("٤٢",), (None,)], "code string")
    assert [r[0] for r in df.select(text.code_format_ok(F.col("code"))).collect()] == [
        True, False, True, False, False, False]


def test_g23_inactive_players_are_hidden(spark):
    players = frames.players(spark, 3, {0, 1})
    totals = spark.createDataFrame([(1, 4), (2, 9)], "player_id bigint, total int")
    assert sorted(tuple(r) for r in scores.leaderboard(players, totals).collect()) == [(0, "P0", 0), (1, "P1", 4)]


def test_first_rules_need_one_voice_and_know_no_deadline(spark):
    cases = {1: case(needed=8), 2: case(needed=8)}
    players = frames.players(spark, 9, {1, 2, 3, 4})
    resolved = ballots.resolve_proposals(
        ballots.under_first_rules(frames.proposals(spark, cases)), frames.votes(spark, [(1, 1, 3, 900), (2, 2, 3, 901)]),
        frames.withdrawals(spark, [(1, 2, 1, 900)]), players)
    assert {r["id"]: (r["status"], r["approved_by"]) for r in resolved.collect()} == {
        1: ("approved", 3), 2: ("withdrawn", None)}


def test_viewer_actions_follow_the_order_of_rules(spark):
    cases = {1: case(needed=8), 2: case(needed=8, proposer=5, target=1), 3: case(needed=8, proposer=5, target=6),
             4: case(needed=8, proposer=5, target=6), 5: case(needed=8)}
    votes = [(1, 5, 3, 1), (2, 3, 1, 1)]
    _, _, _, status, players = outcome(spark, cases, votes, as_of=60)
    log = frames.votes(spark, votes)
    got = {r["id"]: r["action"] for r in feeds.viewer_actions(feeds.recent_proposals(status), log, 1).collect()}
    assert got == {1: "withdraw", 2: "target", 3: "voted", 4: "can_vote", 5: "own"}
    involved = {(r["id"], r["viewer_id"]): r["action"] for r in feeds.involved_actions(status, log).collect()}
    assert {i: a for (i, v), a in involved.items() if v == 1} == {i: a for i, a in got.items() if a != "can_vote"}


def test_feed_cutoff_keeps_the_feed_whole(spark):
    cases = {i: case(created=i * 5, proposer=1, target=2) for i in range(60)}
    gone = [(i, i, 1, i * 5 + 1) for i in range(30, 60, 2)]
    proposals, undone = frames.proposals(spark, cases), frames.withdrawals(spark, gone)
    players, now = frames.players(spark, 9, {1, 2}), F.lit(model.at(300))

    def feed(cutoff):
        resolved = ballots.resolve_proposals(feeds.since(proposals, cutoff), frames.votes(spark, []),
                                             feeds.since(undone, cutoff), players, now)
        recent = feeds.recent_proposals(st.with_derived_status(resolved, now), 20)
        return [r["id"] for r in recent.orderBy(F.desc("id")).collect()]

    cutoff = feeds.feed_cutoff(proposals, undone, now, 20)
    assert feed(cutoff) == feed(None) and len(feed(cutoff)) == 20
    assert feeds.feed_cutoff(proposals, undone, now, 60) is None


def test_time_arithmetic(spark):
    df = spark.createDataFrame([(model.at(0), model.at(90061.5)), (model.at(10), model.at(5))], "a timestamp, b timestamp")
    a, b = F.col("a"), F.col("b")
    left = timing.seconds_left(b, a)
    rows = df.select(left, timing.countdown_text(left), timing.is_urgent(b, a),
                     *timing.duration_parts(a, b).values()).collect()
    assert tuple(rows[0]) == (90062, "1501:02", False, 1, 1, 1)
    assert tuple(rows[1]) == (0, "0:00", True, 0, 0, 0)


def test_bindings_and_deletes(spark):
    players = spark.createDataFrame([(1, "A", True, 7), (2, "B", False, 8), (3, "C", True, None)],
                                    "id bigint, display_name string, is_active boolean, claimed_user_id bigint")
    devices = spark.createDataFrame([(7,), (7,), (8,), (9,)], "device_id bigint")
    assert [tuple(r) for r in people.bound_players(devices, players).collect()] == [(7, 1, "A")]
    assert people.bound_player(players, 7).first()["id"] == 1
    assert people.bound_player(players, 8).isEmpty()
    got = people.with_actor(devices.distinct(), players).collect()
    assert {r["device_id"]: r["actor_id"] for r in got} == {7: 1, 8: None, 9: None}
    gone = spark.createDataFrame([(7,)], "id bigint")
    assert {r["id"]: r["claimed_user_id"] for r in people.null_deleted(players, gone, "claimed_user_id").collect()} == {
        1: None, 2: 8, 3: None}
    assert [r["id"] for r in people.without_deleted(players, spark.createDataFrame([(1,)], "id bigint"), "id")
            .orderBy("id").collect()] == [2, 3]


def test_audit_finds_every_kind_of_violation(spark):
    players = spark.createDataFrame([(1, "A", True, 5), (1, "A", True, 5), (2, "  ", None, None)],
                                    "id bigint, display_name string, is_active boolean, claimed_user_id bigint")
    good = (1, 2, 1, "abc", "pending", None, None, None, model.at(0), 1, "penalty", 2, model.at(120))
    bad = (1, 9, 9, "a", "open", 7, None, None, None, 5, "gift", 3, None)
    pardon = (3, 2, 1, "abc", "approved", 1, model.at(1), None, model.at(0), 2, "pardon", 8, model.at(120))
    proposals = spark.createDataFrame([good, bad, pardon], (
        "id bigint, target_id bigint, proposed_by bigint, description string, status string, approved_by bigint, "
        "approved_at timestamp, withdrawn_at timestamp, created_at timestamp, amount int, proposal_type string, "
        "required_votes int, deadline timestamp"))
    votes = spark.createDataFrame([(1, 1, 1, None), (1, 1, 1, model.at(0)), (2, 8, 9, model.at(0))],
                                  "id bigint, proposal_id bigint, voter_id bigint, created_at timestamp")
    got = {r["rule"]: r["violations"] for r in audit.audit_summary(players, proposals, votes).collect()}
    assert got == {
        "player_name_length": 1, "player_required_columns": 1, "proposal_description_length": 1,
        "proposal_amount_range": 1, "proposal_status_set": 1, "proposal_self_target": 1, "proposal_state_rule": 2,
        "proposal_type_set": 1, "proposal_required_votes_set": 1, "proposal_pardon_amount": 2,
        "proposal_required_columns": 1, "vote_required_columns": 1, "player_name_unique": 1, "player_device_unique": 1,
        "player_key_unique": 1, "proposal_key_unique": 1, "vote_key_unique": 1, "vote_once_per_proposal": 1,
        "proposal_target_exists": 1, "proposal_proposer_exists": 1, "proposal_approver_exists": 1,
        "vote_proposal_exists": 1, "vote_voter_exists": 1}


@pytest.mark.parametrize("amount, needed", [(1, 2), (2, 4), (3, 8)])
def test_votes_for_amount(spark, amount, needed):
    got = spark.range(1).select(rules.votes_for_amount(F.lit(amount))).first()[0]
    assert got == needed

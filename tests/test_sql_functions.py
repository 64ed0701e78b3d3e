"""Functions called by name in SQL, and views."""

import io
from contextlib import redirect_stdout

from frames import SMALL
from quorumbook.sources.fixtures import Fixtures
from quorumbook.operators.status import backfill_legacy
from quorumbook.sources.functions import register_functions
from quorumbook.sources.views import register_views


def test_functions_by_name(spark):
    fx = Fixtures(spark, SMALL)
    names = register_functions(fx.players, fx.proposals, fx.votes, fx.withdrawals, fx.as_of, prefix="t_")
    assert names == ["t_claimed_player", "t_claimed_player_id", "t_replies_to", "t_reply_to_vote"]
    held = {r.claimed_user_id: r for r in fx.players.where("is_active and claimed_user_id is not null").collect()}
    device, player = sorted(held.items())[3]
    rows = spark.sql(f"SELECT * FROM t_claimed_player({device})").collect()
    assert [(r.id, r.display_name) for r in rows] == [(player.id, player.display_name)]
    assert spark.sql("SELECT * FROM t_claimed_player(-1)").collect() == []
    assert spark.sql(f"SELECT t_claimed_player_id({device}), t_claimed_player_id(-1)").first() == (player.id, None)
    voted = spark.sql("SELECT device_id, r.proposal_id, r.receipt FROM t_bindings b, LATERAL t_replies_to(b.id) r "
                      "WHERE r.receipt LIKE '%true%' ORDER BY 1, 2").first()
    reply = spark.sql(f"SELECT t_reply_to_vote({voted.device_id}, {voted.proposal_id})").first()[0]
    assert reply is not None and reply.startswith('{"ok":')


def test_a_lateral_call_is_a_join(spark):
    fx = Fixtures(spark, SMALL)
    register_functions(fx.players, fx.proposals, fx.votes, fx.withdrawals, fx.as_of, prefix="t_")
    out = io.StringIO()
    with redirect_stdout(out):
        spark.sql("SELECT d.id, p.id FROM (SELECT id FROM range(9)) d, LATERAL t_claimed_player(d.id) p").explain()
    assert "Join" in out.getvalue() and "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()


def test_the_leaderboard_view_cuts_heavy_players(spark):
    fx = Fixtures(spark, SMALL)
    stored = backfill_legacy(fx.stored_proposals, fx.as_of)
    boards = []
    for prefix, rows in (("whole_", 10**6), ("cut_", 10)):
        register_views(fx.players, stored, fx.votes, fx.as_of, prefix, rows)
        boards.append(sorted(map(str, spark.sql(f"SELECT * FROM {prefix}leaderboard").collect())))
    assert boards[0] == boards[1] and len(boards[0]) == 139

"""The ledger as temporary views, for those who query it with SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from quorumbook.operators.players import public_players
from quorumbook.operators.scores import heavy_players, leaderboard, plan_stretches, player_totals, score_events
from quorumbook.operators.status import status_view
from quorumbook.plans.skew import ROWS_PER_TASK


def register_views(
    players: DataFrame, stored_proposals: DataFrame, votes: DataFrame, as_of: Column | None = None, prefix: str = "",
    rows_per_task: int = ROWS_PER_TASK,
) -> Sequence[str]:
    """Create or replace the views players, votes, proposal_status and leaderboard.

    Views are computed when they are read; without ``as_of`` the status follows the clock of each statement.  Only
    players who are named by too many proposals for one task are looked for here, and where to cut their events.
    """
    status = status_view(stored_proposals, votes, as_of)
    events = score_events(status)
    cuts = plan_stretches(events, heavy_players(stored_proposals, rows_per_task), rows_per_task)
    views = {
        "players": public_players(players),
        "votes": votes.select("id", "proposal_id", "voter_id", "created_at"),
        "proposal_status": status,
        "leaderboard": leaderboard(players, player_totals(events, cuts)),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in views]

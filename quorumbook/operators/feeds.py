"""What a viewer sees: recent cases, open cases, history and allowed actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumbook.functions.rules import FEED_LIMIT, VISIBLE_STATES, VOTING_SECONDS, affected_player, outcome_kind
from quorumbook.functions.timing import countdown_text, is_urgent, progress_percent, seconds_left
from quorumbook.operators.players import with_player_name


def recent_proposals(status: DataFrame, limit: int | None = FEED_LIMIT) -> DataFrame:
    """Newest visible proposals; the cut comes before any other filter."""
    visible = status.where(F.col("status").isin(*VISIBLE_STATES))
    if limit is None:
        return visible
    return visible.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def open_since(as_of: Column) -> Column:
    """Nothing created before this instant can still be open."""
    return as_of - F.expr(f"interval {VOTING_SECONDS} seconds")


def feed_cutoff(
    proposals: DataFrame, withdrawals: DataFrame, as_of: Column, limit: int = FEED_LIMIT
) -> Column | None:
    """An instant that the newest ``limit`` visible proposals do not precede.

    A proposal that nobody asked to withdraw stays visible, so the newest
    ``limit`` of those bound the feed.  Votes before that instant cannot matter
    to it, which spares the feed the whole log.  None: take everything.
    """
    kept = proposals.where((F.col("created_at") <= as_of) & (F.col("status") != "withdrawn")).select("created_at", "id")
    undone = withdrawals.select(F.col("proposal_id").alias("id"))
    order = [F.desc("created_at"), F.desc("id")]
    # Some more than needed are nearly always enough; if not, look at all.
    for candidates in (kept.orderBy(*order).limit(4 * limit), kept):
        safe = candidates.join(undone, "id", "left_anti").orderBy(*order).limit(limit)
        row = safe.agg(F.count("*").alias("n"), F.min(F.unix_micros("created_at")).alias("cutoff")).first()
        if row["n"] == limit:
            return F.timestamp_micros(F.lit(row["cutoff"]))
    return None


def concerning(proposals: DataFrame, player_id) -> DataFrame:
    """Proposals that can end up in the history of one player."""
    return proposals.where((F.col("target_id") == player_id) | (F.col("proposed_by") == player_id))


def since(df: DataFrame, cutoff: Column | None) -> DataFrame:
    return df if cutoff is None else df.where(F.col("created_at") >= cutoff)


def pending_feed(recent: DataFrame, players: DataFrame, as_of: Column) -> DataFrame:
    """Open cases with progress and time left."""
    rows = recent.where(F.col("status") == "open")
    rows = with_player_name(rows, players, "target_id", "target_name")
    rows = with_player_name(rows, players, "proposed_by", "proposer_name")
    return rows.select(
        "id", "proposal_type", "target_name", "proposer_name", "amount", "vote_count", "required_votes",
        F.round(progress_percent(F.col("vote_count"), F.col("required_votes")), 4).alias("progress"),
        seconds_left(F.col("deadline"), as_of).alias("seconds_left"),
        countdown_text(seconds_left(F.col("deadline"), as_of)).alias("countdown"),
        is_urgent(F.col("deadline"), as_of).alias("is_urgent"),
        "created_at",
    )


def open_count(recent: DataFrame) -> DataFrame:
    return recent.agg(F.count_if(F.col("status") == "open").alias("open_count"))


def history_feed(recent: DataFrame, players: DataFrame, player_id=None) -> DataFrame:
    """Decided cases, optionally those that concern one player."""
    rows = recent.where(F.col("status").isin("approved", "failed")).withColumns({
        "affected_id": affected_player(
            F.col("proposal_type"), F.col("status"), F.col("proposed_by"), F.col("target_id")
        ),
        "kind": outcome_kind(
            F.col("proposal_type"), F.col("status"), F.col("required_votes"), F.col("vote_count")
        ),
    })
    if player_id is not None:
        rows = rows.where(F.col("affected_id") == player_id)
    rows = with_player_name(rows, players, "affected_id", "affected_name")
    rows = with_player_name(rows, players, "proposed_by", "proposer_name")
    return rows.select(
        "id", "kind", "affected_id", "affected_name", "proposer_name", "amount", "vote_count", "required_votes",
        "approved_at", "deadline", "created_at",
    )


def outcome_labels(status: DataFrame) -> DataFrame:
    return status.select(
        "id", "status",
        outcome_kind(
            F.col("proposal_type"), F.col("status"), F.col("required_votes"), F.col("vote_count")
        ).alias("kind"),
    )


def viewer_actions(recent: DataFrame, votes: DataFrame, viewer_id) -> DataFrame:
    """What one viewer may do about each open case."""
    voted = votes.where(F.col("voter_id") == viewer_id).select(
        F.col("proposal_id").alias("id"), F.lit(True).alias("_voted")
    ).distinct()
    viewer = F.lit(viewer_id)
    action = (
        F.when((F.col("proposed_by") == viewer) & (F.col("vote_count") == 0), "withdraw")
        .when(F.col("proposed_by") == viewer, "own")
        .when(F.col("target_id") == viewer, "target")
        .when(F.col("_voted"), "voted")
        .otherwise("can_vote")
    )
    return recent.where(F.col("status") == "open").join(voted, "id", "left").select(
        "id", viewer.alias("viewer_id"), action.alias("action")
    )


def actions_of(status: DataFrame, votes: DataFrame, viewers: DataFrame) -> DataFrame:
    """Number of open cases by viewer and action, for the given viewers.

    Cases are joined only with viewers who are involved in them; on all others a viewer can vote.
    """
    known = viewers.select("viewer_id").distinct()
    involved = involved_actions(status, votes).join(known, "viewer_id", "left_semi").groupBy("viewer_id", "action").agg(
        F.count("*").alias("cases"))
    n_open = status.where(F.col("status") == "open").count()
    taken = involved.groupBy("viewer_id").agg(F.sum("cases").alias("taken"))
    rest = known.join(taken, "viewer_id", "left").select(
        "viewer_id", F.lit("can_vote").alias("action"), (F.lit(n_open) - F.coalesce("taken", F.lit(0))).alias("cases"))
    return involved.unionByName(rest.where("cases > 0"))


def involved_actions(status: DataFrame, votes: DataFrame) -> DataFrame:
    """The same for every viewer who is involved in an open case.

    Viewers without a row here are not involved: they can vote.
    """
    open_cases = status.where(F.col("status") == "open")
    own = open_cases.select(
        "id", F.col("proposed_by").alias("viewer_id"),
        F.when(F.col("vote_count") == 0, "withdraw").otherwise("own").alias("action"),
    )
    target = open_cases.select("id", F.col("target_id").alias("viewer_id"), F.lit("target").alias("action"))
    voted = votes.select(F.col("proposal_id").alias("id"), F.col("voter_id").alias("viewer_id")).join(
        open_cases.select("id"), "id", "left_semi"
    ).select("id", "viewer_id", F.lit("voted").alias("action"))
    return own.unionByName(target).unionByName(voted)

"""Votes and withdrawals: what each command did, and what was decided.

The logs are append-only.  A decision depends on one proposal only, so the work
is partitioned by proposal; rows of heavy proposals take a second path in which
they meet a bounded broadcast and are reduced before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumbook.functions.rules import MAX_REQUIRED_VOTES
from quorumbook.operators.players import with_active_flag
from quorumbook.plans.skew import ROWS_PER_TASK, broadcast_if_small, heavy_keys, is_heavy, partitions_for

_RULE_COLUMNS = ["proposed_by", "target_id", "required_votes", "created_at", "deadline", "status"]


def until(df: DataFrame, as_of: Column | None, column: str = "created_at") -> DataFrame:
    return df if as_of is None else df.where(F.col(column) <= as_of)


def commands_on(commands: DataFrame, proposals: DataFrame) -> DataFrame:
    """The commands on a selection of proposals, found without a shuffle when it is small."""
    chosen = proposals.select(F.col("id").alias("proposal_id"))
    return commands.join(broadcast_if_small(chosen), "proposal_id", "left_semi")


def under_first_rules(proposals: DataFrame) -> DataFrame:
    """The same proposals under the rules before group voting."""
    return proposals.withColumns({
        "required_votes": F.lit(1).cast("smallint"),
        "deadline": F.lit(None).cast("timestamp"),
    })


def _rules(proposals: DataFrame) -> DataFrame:
    return proposals.selectExpr("id as proposal_id", *[f"{c} as _{c}" for c in _RULE_COLUMNS])


def _commands(votes: DataFrame, withdrawals: DataFrame | None) -> DataFrame:
    """Votes and withdrawals as one stream of rows."""
    rows = votes.selectExpr("proposal_id", "voter_id as actor_id", "id", "created_at", "true as is_vote")
    if withdrawals is None:
        return rows
    return rows.unionByName(
        withdrawals.selectExpr("proposal_id", "actor_id", "id", "created_at", "false as is_vote")
    )


# A command that may count: pending proposal, in time (the deadline included), by somebody entitled.
_VALID = f"""_status = 'pending' and _required_votes <= {MAX_REQUIRED_VOTES} and created_at >= _created_at and coalesce(created_at <= _deadline, true)
    and if(is_vote, actor_id <> _proposed_by and actor_id <> _target_id, actor_id = _proposed_by)"""

# Per proposal there is at most one first withdrawal, and it ranks before the votes.  A proposal that asks for more
# votes than the rules know takes none; its votes are refused as such.
_RANK_LIMIT = MAX_REQUIRED_VOTES + 1


def _decide(commands: DataFrame, rules: DataFrame, track_ids: bool, flagged: bool = False) -> DataFrame:
    """One row per proposal that received a valid command.

    ``flagged`` commands still hold those of inactive players.  They are left
    out inside the aggregate, not by a filter: Spark would move a filter below
    the shuffle, and the shuffle could no longer serve the caller's second use.
    """
    first = "min(struct(created_at, id))" if track_ids else "min(created_at)"
    if flagged:
        valid = commands.join(rules, "proposal_id", "left")
        first += f" filter (where _active and {_VALID})"
    else:
        valid = commands.join(rules, "proposal_id").where(_VALID)
    firsts = valid.groupBy("proposal_id", "is_vote", "actor_id").agg(
        F.expr(first).alias("first"), F.min("_required_votes").alias("required_votes")
    )
    if flagged:
        firsts = firsts.where("first is not null")
    if track_ids:
        firsts = firsts.selectExpr(
            "proposal_id", "is_vote", "actor_id", "required_votes", "first.created_at as first", "first.id as id"
        )
    order = Window.partitionBy("proposal_id").orderBy("is_vote", "first", "actor_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # The constant bound lets Spark cut each group before a shuffle; the
    # proposal's own threshold is applied after it.
    ranked = (
        firsts.withColumns({
            "place": F.row_number().over(order),
            "undone": F.sum(F.expr("if(is_vote, 0, 1)")).over(order),
        })
        .where(F.col("place") <= _RANK_LIMIT)
        .selectExpr("*", "cast(place - undone as int) as rank")
        .where("not is_vote or rank <= required_votes")
    )
    last = "is_vote and rank = required_votes"
    aggregates = [
        "min(if(is_vote, null, first)) as withdrawal_at", "min(if(is_vote, first, null)) as first_vote_at",
        "cast(count_if(is_vote) as int) as n_votes",
        f"max(if({last}, first, null)) as reached_at", f"max(if({last}, actor_id, null)) as reached_by",
    ]
    if track_ids:
        aggregates += [
            "max(if(is_vote, null, id)) as withdrawal_id", f"max(if({last}, id, null)) as reached_id",
            # At most eight entries, in voting order.
            "array_sort(collect_list(if(is_vote, struct(rank, id, actor_id as voter_id, first as created_at), null)))"
            " as listed",
        ]
    tally = ranked.groupBy("proposal_id").agg(*[F.expr(a) for a in aggregates])
    columns = ["proposal_id", "if(undone, withdrawal_at, null) as withdrawn_at", "if(undone, 0, n_votes) as vote_count",
               "if(undone, null, reached_at) as approved_at", "if(undone, null, reached_by) as approved_by"]
    if track_ids:
        columns += ["if(undone, withdrawal_id, null) as withdrawal_id", "if(undone, null, reached_id) as approval_id",
                    "if(undone, slice(listed, 1, 0), listed) as accepted"]
    undone = "withdrawal_at is not null and coalesce(withdrawal_at <= first_vote_at, true)"
    return tally.withColumn("undone", F.expr(undone)).selectExpr(*columns)


def _flagged(votes: DataFrame, withdrawals: DataFrame | None, players: DataFrame, as_of: Column | None) -> DataFrame:
    return with_active_flag(until(_commands(votes, withdrawals), as_of), players, "actor_id", "_active")


def _split(df: DataFrame, heavy: Sequence) -> tuple[DataFrame, DataFrame]:
    hit = is_heavy(F.col("proposal_id"), heavy)
    return df.where(~hit), df.where(hit)


def decisions(
    proposals: DataFrame,
    votes: DataFrame,
    withdrawals: DataFrame | None,
    players: DataFrame,
    as_of: Column | None = None,
    heavy: Sequence | None = None,
    track_ids: bool = True,
) -> DataFrame:
    """What the logs decided, one row per proposal with a valid command.

    A withdrawal counts when it came no later than the first vote.  ``heavy``
    names the proposals with too many votes for one task; by default they are
    looked for, which counts the votes.  With ``track_ids`` the row also names the deciding commands and lists the accepted
    votes in order (``accepted``, at most eight).
    """
    heavy = heavy_proposals(votes) if heavy is None else heavy
    rows = _flagged(votes, withdrawals, players, as_of).where("_active").drop("_active")
    rules = _rules(proposals)
    if not heavy:
        # One shuffle of the log; all that follows keeps this partitioning.
        return _decide(rows.repartition(*partitions_for(votes), "proposal_id"), rules, track_ids)
    cold, hot = _split(rows, heavy)
    # Bounded by the number of heavy keys, see plans.skew.
    hot_rules = F.broadcast(_split(rules, heavy)[1])
    cold = cold.repartition(*partitions_for(votes), "proposal_id")
    return _decide(cold, rules, track_ids).unionByName(_decide(hot, hot_rules, track_ids))


def heavy_proposals(votes: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> list:
    return heavy_keys(votes, "proposal_id", rows_per_task)


def resolve_proposals(
    proposals: DataFrame,
    votes: DataFrame,
    withdrawals: DataFrame | None,
    players: DataFrame,
    as_of: Column | None = None,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Proposals with the stored state that the logs lead to, and the vote count."""
    made = until(proposals, as_of)
    decided = decisions(made, votes, withdrawals, players, as_of, heavy, track_ids=False).selectExpr(
        "proposal_id as id", "vote_count", "approved_by as _by", "approved_at as _at", "withdrawn_at as _gone"
    )
    derived = {
        "status": "case when status <> 'pending' then status when _at is not null then 'approved' "
                  "when _gone is not null then 'withdrawn' else 'pending' end",
        "approved_by": "if(status = 'pending', _by, approved_by)",
        "approved_at": "if(status = 'pending', _at, approved_at)",
        "withdrawn_at": "if(status = 'pending', _gone, withdrawn_at)",
    }
    columns = [f"{derived[c]} as {c}" if c in derived else c for c in proposals.columns]
    return made.join(decided, "id", "left").selectExpr(*columns, "coalesce(vote_count, 0) as vote_count")


def accepted_votes(decided: DataFrame) -> DataFrame:
    """The stored votes: one row per accepted vote, numbered in order."""
    return decided.select("proposal_id", F.explode("accepted").alias("v")).select(
        F.col("v.id").alias("id"), "proposal_id", F.col("v.voter_id").alias("voter_id"),
        F.col("v.created_at").alias("created_at"), F.col("v.rank").alias("vote_number"),
    )


_VOTE_OUTCOME = """case
    when not is_vote then null
    when not _active then 'no_identity'
    when _found is null or created_at < _created_at then 'not_found'
    when _status <> 'pending' or withdrawn_at <= created_at
        or approved_at is not null and struct(created_at, actor_id, id) > struct(approved_at, approved_by, approval_id)
        then 'already_decided'
    when created_at > _deadline then 'past_deadline'
    when _required_votes > {most} then 'unknown_threshold'
    when actor_id = _proposed_by or actor_id = _target_id then 'not_eligible'
    when _position > 0 and _delivery = 1 then 'accepted'
    else 'duplicate' end""".format(most=MAX_REQUIRED_VOTES)

# The entry of a vote among the accepted ones: there is one per voter, known by its time and id.
_ACCEPTED_HERE = "filter(accepted, v -> v.voter_id = actor_id and v.created_at = created_at and v.id <=> id)"
# A log may deliver a vote more than once; the copies come one after the other.
_DELIVERY = "row_number() over (partition by proposal_id, actor_id, created_at, id, is_vote order by 0)"


def _classify_votes(rows: DataFrame, rules: DataFrame, decided: DataFrame, small: bool = False) -> DataFrame:
    rules = rules.withColumn("_found", F.lit(True))
    decided = decided.drop("vote_count")
    if small:
        rules, decided = F.broadcast(rules), F.broadcast(decided)
    return (
        rows.join(rules, "proposal_id", "left").join(decided, "proposal_id", "left")
        .withColumn("_position", F.coalesce(F.get(F.expr(_ACCEPTED_HERE), F.lit(0)).getField("rank"), F.lit(0)))
        .withColumn("_delivery", F.expr(_DELIVERY))
        .withColumn("outcome", F.expr(_VOTE_OUTCOME))
        .where("outcome is not null")
        .selectExpr(
            "id", "proposal_id", "actor_id as voter_id", "created_at", "outcome",
            "if(outcome = 'accepted', _position, null) as vote_count",
            "if(outcome = 'accepted', _required_votes, null) as required_votes",
            "if(outcome = 'accepted', if(_position = _required_votes, 'approved', 'open'), null) as status",
        )
    )


def classify_votes(
    proposals: DataFrame,
    votes: DataFrame,
    withdrawals: DataFrame | None,
    players: DataFrame,
    as_of: Column | None = None,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Each vote accepted, or refused with the first failing rule.

    Accepted votes also tell the count they led to and the resulting status.
    The log is used twice, to decide and to judge each vote by the decision;
    both uses read one shuffle.
    """
    heavy = heavy_proposals(votes) if heavy is None else heavy
    rules = _rules(until(proposals, as_of))
    everything = _flagged(votes, withdrawals, players, as_of)
    # Votes that name no proposal need no lookup; without them both uses of the
    # log have the same filter, which joins on the key would add to one of them.
    rows = everything.where("proposal_id is not null")
    nameless = everything.where("proposal_id is null and is_vote").selectExpr(
        "id", "proposal_id", "actor_id as voter_id", "created_at", "if(_active, 'not_found', 'no_identity') as outcome",
        "cast(null as int) as vote_count", "cast(null as smallint) as required_votes", "cast(null as string) as status",
    )
    cold, hot = _split(rows, heavy) if heavy else (rows, None)
    cold = cold.repartition(*partitions_for(votes), "proposal_id")
    judged = _classify_votes(cold, rules, _decide(cold, rules, True, flagged=True)).unionByName(nameless)
    if hot is None:
        return judged
    # Bounded by the number of heavy keys, each with at most eight accepted votes.
    hot_rules = _split(rules, heavy)[1]
    hot_decided = _decide(hot.where("_active"), F.broadcast(hot_rules), True)
    return judged.unionByName(_classify_votes(hot, hot_rules, hot_decided, small=True))


# The name by which older callers cast a vote.
second_proposals = classify_votes


def classify_withdrawals(
    proposals: DataFrame,
    votes: DataFrame,
    withdrawals: DataFrame,
    players: DataFrame,
    as_of: Column | None = None,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Each withdrawal accepted or refused; only the first valid one before any vote counts."""
    made = until(proposals, as_of)
    decided = decisions(made, votes, withdrawals, players, as_of, heavy).select(
        "proposal_id", F.col("withdrawal_id").alias("_accepted_id")
    )
    rows = with_active_flag(until(withdrawals, as_of), players, "actor_id", "_active")
    # Proposals without a withdrawal hold no row here, so the side stays small.
    effective = decided.where(F.col("_accepted_id").isNotNull())
    joined = rows.join(effective, "proposal_id", "left")
    outcome = (
        F.when(~F.col("_active"), "no_identity")
        .when(F.coalesce(F.col("_accepted_id") == F.col("id"), F.lit(False)), "accepted")
        .otherwise("refused")
    )
    return joined.select("id", "proposal_id", "actor_id", "created_at", outcome.alias("outcome"))


def vote_receipts(classified: DataFrame) -> DataFrame:
    """The reply to each vote as JSON text."""
    reply = F.when(
        F.col("outcome") == "accepted",
        F.to_json(F.struct(F.lit(True).alias("ok"), "status", "vote_count", "required_votes")),
    ).otherwise(F.to_json(F.struct(F.lit(False).alias("ok"), F.col("outcome").alias("error"))))
    return classified.select("id", "proposal_id", "voter_id", "created_at", reply.alias("receipt"))


def approval_moments(decided: DataFrame) -> DataFrame:
    """The vote that reached the threshold, for approved proposals."""
    return decided.where("approved_at is not null").select("proposal_id", "approved_by", "approved_at", "vote_count")


def voters_by_proposal(decided: DataFrame) -> DataFrame:
    """The accepted voters of each proposal as a sorted, comma-joined text."""
    voters = F.array_sort(F.transform("accepted", lambda v: v["voter_id"]))
    return decided.where(F.array_size("accepted") > 0).select(
        "proposal_id",
        F.array_size("accepted").alias("n_voters"),
        F.array_join(voters.cast("array<string>"), ",").alias("voters"),
    )


__all__ = [
    "accepted_votes", "approval_moments", "classify_votes", "classify_withdrawals", "commands_on", "decisions",
    "heavy_proposals", "resolve_proposals", "second_proposals", "under_first_rules", "until", "vote_receipts",
    "voters_by_proposal",
]

"""Voting rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the game rules.
VOTES_FOR_AMOUNT = {1: 2, 2: 4, 3: 8}
PARDON_VOTES = 8
LEGACY_VOTES = 1
MAX_REQUIRED_VOTES = 8
VOTING_SECONDS = 120
MIN_AMOUNT, MAX_AMOUNT = 1, 3
MIN_TEXT, MAX_TEXT = 3, 500
MIN_NAME, MAX_NAME = 1, 40
FEED_LIMIT = 250
# Milliseconds without a change after which a reader reads again.
REFRESH_QUIET_MILLIS = 180
CODE_DIGITS = 2
URGENT_SECONDS = 30
MAX_WRONG_CODES = 5
THROTTLE_SECONDS = 15 * 60
REQUIRED_VOTES_ALLOWED = (1, 2, 4, 8)
PROPOSAL_TYPES = ("penalty", "pardon")
STORED_STATES = ("pending", "approved", "withdrawn")
VISIBLE_STATES = ("open", "approved", "failed")


def votes_for_amount(amount: Column) -> Column:
    """Votes needed by a penalty of the given amount; other amounts need the most."""
    return (
        F.when(amount == 1, F.lit(VOTES_FOR_AMOUNT[1]))
        .when(amount == 2, F.lit(VOTES_FOR_AMOUNT[2]))
        .otherwise(F.lit(VOTES_FOR_AMOUNT[3]))
        .cast("smallint")
    )


def required_votes(proposal_type: Column, amount: Column) -> Column:
    return (
        F.when(proposal_type == "pardon", F.lit(PARDON_VOTES).cast("smallint"))
        .otherwise(votes_for_amount(amount))
    )


def voting_deadline(created_at: Column) -> Column:
    return created_at + F.expr(f"interval {VOTING_SECONDS} seconds")


def derived_status(stored: Column, deadline: Column, as_of: Column) -> Column:
    """Stored decisions win over time; the deadline itself still counts as open."""
    return (
        F.when(stored == "approved", F.lit("approved"))
        .when(stored == "withdrawn", F.lit("withdrawn"))
        .when(as_of > deadline, F.lit("failed"))
        .otherwise(F.lit("open"))
    )


def affected_player(proposal_type: Column, status: Column, proposer: Column, target: Column) -> Column:
    """A penalty that backfired concerns its proposer, everything else the target."""
    return F.when((proposal_type == "penalty") & (status == "failed"), proposer).otherwise(target)


def outcome_kind(proposal_type: Column, status: Column, required: Column, votes: Column) -> Column:
    """Stable English code for what became of a proposal."""
    pardon = proposal_type == "pardon"
    return (
        F.when(
            (status == "approved") & (required == LEGACY_VOTES) & (votes == 0),
            F.when(pardon, F.lit("pardoned_legacy")).otherwise(F.lit("adopted_legacy")),
        )
        .when(status == "approved", F.when(pardon, F.lit("pardoned")).otherwise(F.lit("adopted")))
        .when(status == "failed", F.when(pardon, F.lit("rejected")).otherwise(F.lit("backfired")))
        .when(status == "open", F.when(pardon, F.lit("pardon_vote")).otherwise(F.lit("penalty_vote")))
        .otherwise(F.lit("withdrawn"))
    )

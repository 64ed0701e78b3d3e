"""Admission of proposal commands: accepted, or refused with the first failing rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumbook.functions.rules import MAX_AMOUNT, MAX_TEXT, MIN_AMOUNT, MIN_TEXT, required_votes, voting_deadline
from quorumbook.functions.text import cleaned
from quorumbook.operators.players import with_active_flag
from quorumbook.sources.tables import with_default


def classify_proposals(commands: DataFrame, players: DataFrame, *, voting: bool = True) -> DataFrame:
    """Outcome of each proposal command, with the row it would store.

    Commands carry ``actor_id`` (null or inactive: no identity), ``target_id``,
    ``description`` and optionally ``amount`` (missing column: 1) and
    ``proposal_type`` (missing column: penalty).  With ``voting=False`` the
    rules from before group voting apply: one approving voice, no deadline.
    """
    if "amount" not in commands.columns:
        commands = commands.withColumn("amount", F.lit(1))
    commands = with_default(commands, "proposal_type", "penalty")
    pardon = F.col("proposal_type") == "pardon"
    # The text is reduced to its cleaned form and length before any lookup, so
    # plans that need the length only do not carry the text through a shuffle.
    rows = commands.withColumns({
        "description": cleaned(F.col("description")),
        "amount": F.when(pardon, F.lit(1)).otherwise(F.col("amount")),
    }).withColumn("text_length", F.char_length("description"))
    rows = with_active_flag(rows, players, "actor_id", "_actor_ok")
    rows = with_active_flag(rows, players, "target_id", "_target_ok")
    text_ok = F.coalesce(F.col("text_length").between(MIN_TEXT, MAX_TEXT), F.lit(False))
    amount_ok = F.coalesce(F.col("amount").between(MIN_AMOUNT, MAX_AMOUNT), F.lit(False))
    outcome = (
        F.when(~F.col("_actor_ok"), "no_identity")
        .when(F.col("actor_id") == F.col("target_id"), "self_target")
        .when(~F.col("_target_ok"), "unknown_target")
        .when(~text_ok, "bad_description")
        .when(~amount_ok, "bad_amount")
        .otherwise("accepted")
    )
    rows = rows.withColumn("outcome", outcome)
    ok = F.col("outcome") == "accepted"
    amount = F.col("amount").cast("smallint")
    needed = required_votes(F.col("proposal_type"), amount) if voting else F.lit(1).cast("smallint")
    deadline = voting_deadline(F.col("created_at")) if voting else F.lit(None).cast("timestamp")
    return rows.select(
        "id", "actor_id", "target_id", "description", "text_length",
        F.when(ok, amount).alias("amount"),
        "proposal_type",
        F.when(ok, needed).alias("required_votes"),
        "created_at",
        F.when(ok, deadline).alias("deadline"),
        "outcome",
    )

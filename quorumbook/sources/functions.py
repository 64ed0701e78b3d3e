"""The lookups that users call by name, as functions of Spark SQL.

A table function is a query with a parameter: Spark puts it in place of the call, so
``FROM devices d, LATERAL claimed_player(d.device_id)`` becomes a join of the devices
with the players, and a call with a literal becomes a filter that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumbook.operators.ballots import classify_votes, vote_receipts

_FUNCTIONS = {
    "claimed_player(device BIGINT) RETURNS TABLE(id BIGINT, display_name STRING)": """
        SELECT b.id, b.display_name FROM {prefix}bindings b WHERE b.device_id = device""",
    "claimed_player_id(device BIGINT) RETURNS BIGINT": """
        (SELECT min(b.id) FROM {prefix}bindings b WHERE b.device_id = device)""",
    "replies_to(voter BIGINT) RETURNS TABLE(proposal_id BIGINT, created_at TIMESTAMP, receipt STRING)": """
        SELECT r.proposal_id, r.created_at, r.receipt FROM {prefix}vote_replies r WHERE r.voter_id = voter""",
    "reply_to_vote(device BIGINT, proposal BIGINT) RETURNS STRING": """
        (SELECT min_by(r.receipt, r.created_at) FROM {prefix}vote_replies r JOIN {prefix}bindings b ON b.id = r.voter_id
         WHERE b.device_id = device AND r.proposal_id = proposal)""",
}


def register_functions(
    players: DataFrame, proposals: DataFrame, votes: DataFrame, withdrawals: DataFrame, as_of: Column | None = None,
    prefix: str = "",
) -> Sequence[str]:
    """Create or replace the functions and the views ``bindings`` and ``vote_replies`` that they read.

    claimed_player(device), claimed_player_id(device): the active player of a device.
    replies_to(voter): the reply to each of a player's votes.
    reply_to_vote(device, proposal): the reply to the first vote of the device's player on a proposal.
    """
    spark = players.sparkSession
    held = players.where("is_active and claimed_user_id is not null").groupBy(
        F.col("claimed_user_id").alias("device_id")).agg(F.min(F.struct("id", "display_name")).alias("player"))
    held.select("device_id", "player.*").createOrReplaceTempView(f"{prefix}bindings")
    replies = vote_receipts(classify_votes(proposals, votes, withdrawals, players, as_of))
    replies.createOrReplaceTempView(f"{prefix}vote_replies")
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURN {body.format(prefix=prefix)}")
    return [f"{prefix}{signature.split('(')[0]}" for signature in _FUNCTIONS]

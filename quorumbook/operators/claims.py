"""Claim attempts replayed: who ends up bound to which player."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumbook.operators.throttle import heavy_devices, walk_attempts
from quorumbook.plans.workspace import materialize

_NEVER = 2**63 - 1
_SETTLED = "device_id bigint, horizon bigint, player_id bigint, claim_seq bigint"


def _prepared(attempts: DataFrame, players: DataFrame) -> DataFrame:
    """Attempts with what the players table says about the player and the device."""
    known = players.where("is_active").selectExpr(
        "id as player_id", "true as known", "coalesce(has_code, false) as has_code", "claimed_user_id as owner"
    )
    holders = players.where("is_active and claimed_user_id is not null").groupBy(
        F.col("claimed_user_id").alias("device_id")
    ).agg(F.min("id").alias("held_player"))
    return (
        attempts.selectExpr("device_id", "seq", "unix_micros(ts) as at", "player_id", "format_ok", "code_ok")
        .join(known, "player_id", "left").join(holders, "device_id", "left")
        .selectExpr(
            "device_id", "seq", "at", "coalesce(player_id, -1L) as player_id", "coalesce(known, false) as known",
            "coalesce(has_code, false) as has_code", "format_ok", "code_ok",
            f"if(owner is not null and owner <> device_id, -1L, {_NEVER}L) as owned_at",
            "coalesce(held_player, -1L) as held_player",
        )
    )


def _could_bind(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """Attempts that may still bind a player, given what is settled."""
    claimed = settled.where("player_id is not null").select("player_id").distinct()
    return (
        rows.where(f"known and has_code and format_ok and code_ok and held_player < 0 and owned_at = {_NEVER}")
        .join(settled.selectExpr("device_id", "horizon", "player_id as got").hint("merge"), "device_id", "left")
        .where("got is null and (horizon is null or seq >= horizon)")
        .join(claimed.hint("merge"), "player_id", "left_anti")
        .select("player_id", "device_id", "seq")
    )


def rivals(possible: DataFrame) -> DataFrame:
    """Earliest possible claim of each player, and the earliest by a second device."""
    firsts = possible.groupBy("player_id", "device_id").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("player_id").orderBy("seq", "device_id")
    return (
        firsts.withColumn("place", F.row_number().over(order)).where("place <= 2")
        .groupBy("player_id").agg(
            F.max(F.expr("if(place = 1, device_id, null)")).alias("first_device"),
            F.max(F.expr("if(place = 1, seq, null)")).alias("first_seq"),
            F.max(F.expr("if(place = 2, seq, null)")).alias("second_seq"),
        )
    )


def _faced(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """Attempts with the moment their player was claimed by another device."""
    claims = settled.where("player_id is not null").selectExpr("player_id", "device_id as claimer", "claim_seq")
    taken = f"least(owned_at, if(claimer is not null and claimer <> device_id, claim_seq, {_NEVER}L))"
    return rows.join(claims.hint("merge"), "player_id", "left").selectExpr(
        *rows.columns, f"{taken} as taken_at", f"known and has_code and format_ok and {taken} >= seq as counts"
    )


def _settle(faced: DataFrame, earliest: DataFrame, heavy: Sequence) -> DataFrame:
    """How far each device's attempts are certain, and what it binds before that.

    An attempt on a player whom another device might claim earlier is not
    certain; nor is anything the device does later.
    """
    rival = f"coalesce(if(first_device = device_id, second_seq, first_seq), {_NEVER}L)"
    rows = faced.join(earliest.hint("merge"), "player_id", "left").selectExpr(
        "device_id", "seq", "at", "player_id", "counts", "code_ok", f"{rival} < seq as open"
    )
    ends = walk_attempts(rows, heavy).groupBy("device_id").agg(
        F.expr(f"coalesce(min(if(open, seq, null)), {_NEVER}L)").alias("horizon"),
        F.expr("min(struct(seq, player_id)) filter (where outcome = 'ok')").alias("first"),
    )
    return ends.selectExpr(
        "device_id", "horizon", "if(first.seq < horizon, first.player_id, null) as player_id",
        "if(first.seq < horizon, first.seq, null) as claim_seq",
    )


_RESULT = """case
    when bound_at < seq then if(bound_player = player_id, 'already_bound_here', 'device_already_bound')
    when not known then 'player_not_found'
    when taken_at < seq then 'player_already_claimed'
    when outcome <> 'not_counted' then outcome
    when not has_code then 'code_not_configured'
    else 'invalid_code_format' end"""


def resolve_claims(attempts: DataFrame, players: DataFrame, heavy: Sequence | None = None) -> DataFrame:
    """Result of every claim attempt, in the order of the log's ``seq``.

    ``seq`` numbers the log in the order of time.  A claim ties a device to a
    player, so devices that try the same players depend on each other.  Each
    round settles every device up to the first attempt that an unsettled claim
    of another device could still change; the earliest open claim is always
    settled, so the rounds end.  What is settled is written out after each round
    and merged with the attempts; broadcasts would send it through the driver each time.
    """
    heavy = heavy_devices(attempts) if heavy is None else heavy
    rows = materialize(_prepared(attempts, players), "claim-attempts")
    # A device that holds a player from the start has nothing to settle.
    free = rows.where("held_player < 0")
    settled = rows.sparkSession.createDataFrame([], _SETTLED)
    while True:
        earliest = materialize(rivals(_could_bind(rows, settled)), "claim-rivals")
        if earliest.isEmpty():
            break
        # Devices that bound or have nothing left to settle keep their row.
        closed = settled.where(f"player_id is not null or horizon = {_NEVER}")
        still = free.join(closed.select("device_id").hint("merge"), "device_id", "left_anti")
        settled = materialize(
            closed.unionByName(_settle(_faced(still, settled), earliest, heavy)), "claim-settled"
        )
    bound = settled.where("player_id is not null").selectExpr(
        "device_id", "player_id as bound_player", "claim_seq as bound_at"
    )
    final = _faced(rows, settled).join(bound, "device_id", "left").withColumns({
        "bound_at": F.expr(f"if(held_player >= 0, -1L, coalesce(bound_at, {_NEVER}L))"),
        "bound_player": F.expr("if(held_player >= 0, held_player, coalesce(bound_player, -1L))"),
    })
    return walk_attempts(final, heavy).selectExpr(
        "device_id", "seq", "nullif(player_id, -1L) as player_id", f"{_RESULT} as outcome"
    )


def claimed_players(resolved: DataFrame) -> DataFrame:
    """The bindings made: one row per claimed player."""
    return resolved.where("outcome = 'ok'").select("player_id", "device_id", "seq")


def claim_receipts(resolved: DataFrame, players: DataFrame) -> DataFrame:
    """The reply to each claim as JSON text, with the bound player nested in it."""
    names = players.select(F.col("id").alias("player_id"), "display_name")
    return resolved.join(names, "player_id", "left").selectExpr(
        "device_id", "seq",
        """case when outcome in ('ok', 'already_bound_here') then
            to_json(named_struct('ok', true, 'player', named_struct('id', player_id, 'display_name', display_name)))
        else to_json(named_struct('ok', false, 'error',
            if(outcome = 'locked_now', 'temporarily_blocked', outcome))) end as receipt""",
    )

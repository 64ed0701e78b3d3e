"""Players over time: added, given a new code, taken out; and claims judged as of their moment.

An organiser's log names a player and says what happens: ``insert`` adds one with a
code, ``reset`` gives a new code and frees the player from the device that holds it,
``deactivate`` takes the player out for good.  From it follow periods in which a
player's row does not change; a command meets the row that held at its moment by an
as-of join of its sequence number with the periods.

A player between two resets is a *slot*.  A slot is claimed at most once, and whoever
claims it is bound until the slot ends, so a device may claim again after a reset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumbook.operators.claims import rivals
from quorumbook.operators.throttle import heavy_devices, walk_attempts
from quorumbook.plans.workspace import materialize

NEVER = 2**63 - 1
#: Resets of one player that a slot's number has room for.
_SLOTS = 2**20
_START = -1


def named_changes(players: DataFrame, log: DataFrame) -> DataFrame:
    """The log with the id of the player it names; changes of nobody change nothing.

    An insert brings its id (``new_id``).  A name that is taken already is not inserted again.
    """
    made = log.where("op = 'insert' and new_id is not null").join(
        players.select("display_name"), "display_name", "left_anti").groupBy("display_name").agg(
        F.min(F.struct("seq", "new_id")).alias("made"))
    names = players.selectExpr("display_name", "id as player_id", f"{_START}L as made_at").unionByName(
        made.selectExpr("display_name", "made.new_id as player_id", "made.seq as made_at"))
    return log.join(names.hint("merge"), "display_name").where("seq > made_at and op <> 'insert' or seq = made_at").select(
        "player_id", "display_name", "seq", "changed_at", "op", "code")


def player_periods(players: DataFrame, log: DataFrame) -> DataFrame:
    """Every stretch in which a player's row is the same: from ``since`` (excluded) to ``until`` (excluded).

    ``slot`` numbers the player between two resets, ``ends`` is the end of whatever binding the slot has.
    """
    first = players.selectExpr(
        "id as player_id", "display_name", f"{_START}L as seq", "cast(null as timestamp) as changed_at", "'start' as op",
        "cast(null as string) as code", "is_active", "coalesce(has_code, false) as has_code", "claimed_user_id as owner")
    steps = first.unionByName(named_changes(players, log), allowMissingColumns=True)
    so_far = Window.partitionBy("player_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("player_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)

    def seen(*ops: str):
        return F.count_if(F.col("op").isin(*ops)).over(so_far)

    def coming(seq):
        return F.coalesce(F.min(seq).over(after), F.lit(NEVER))

    # Only the row of the start says whether the player was active; whoever is added is.
    active_first = F.coalesce(F.first("is_active", True).over(so_far), F.lit(True))
    return steps.select(
        "player_id", "display_name", F.col("seq").alias("since"), coming(F.col("seq")).alias("until"),
        (active_first & (seen("deactivate") == 0)).alias("is_active"),
        (F.coalesce(F.max("has_code").over(so_far), F.lit(False)) | (seen("reset", "insert") > 0)).alias("has_code"),
        F.last("code", True).over(so_far).alias("code"), seen("reset").alias("resets"),
        F.max(F.when(F.col("op") == "reset", F.col("changed_at"))).over(so_far).alias("reset_at"),
        F.when(seen("reset") == 0, F.max("owner").over(so_far)).alias("owner"),
        (F.col("player_id") * _SLOTS + seen("reset")).alias("slot"),
        coming(F.when(F.col("op").isin("reset", "deactivate"), F.col("seq"))).alias("ends"),
    )


def players_now(periods: DataFrame) -> DataFrame:
    """The players table after the whole log, with the number and the time of resets."""
    return periods.where(F.col("until") == NEVER).select(
        F.col("player_id").alias("id"), "display_name", "is_active", "has_code", "code",
        F.col("owner").alias("claimed_user_id"), F.col("resets").cast("int").alias("resets"), "reset_at")


def as_of(commands: DataFrame, periods: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each command with its player's row at its moment (``columns``), nulls where there was no such player.

    The player is the key of the join and the period its residual condition, so a player of very many
    commands is split like any other skewed key.
    """
    held = periods.select(F.col("player_id").alias("_player"), "since", "until", *columns)
    matches = (F.col("player_id") == F.col("_player")) & F.col("seq").between(F.col("since") + 1, F.col("until") - 1)
    return commands.join(held.hint("merge"), matches, "left").drop("_player", "since", "until")


def _prepared(attempts: DataFrame, periods: DataFrame) -> DataFrame:
    rows = attempts.selectExpr("device_id", "seq", "unix_micros(ts) as at", "player_id", "format_ok", "code_ok")
    return as_of(rows, periods, ["is_active", "has_code", "slot", "ends"]).selectExpr(
        "device_id", "seq", "at", "coalesce(player_id, -1L) as player_id", "coalesce(is_active, false) as known",
        "coalesce(has_code, false) as has_code", "format_ok", "code_ok", "coalesce(slot, -1L) as slot",
        f"coalesce(ends, {NEVER}L) as ends")


def _holders(periods: DataFrame) -> DataFrame:
    """Bindings that the players table begins with; the lowest id decides if a device holds several players."""
    start = periods.where(f"since = {_START} and is_active and owner is not null")
    return start.groupBy(F.col("owner").alias("device_id")).agg(
        F.min(F.struct("slot", F.lit(_START).cast("bigint").alias("claim_seq"), "ends")).alias("b")
    ).select("device_id", "b.*")


def _faced(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """Attempts with the binding that their device is in, and who has claimed their player's slot."""
    claims = bindings.selectExpr("slot", "device_id as claimer", "claim_seq as claimed_at")
    mine = bindings.selectExpr("device_id as _device", "slot as bound_slot", "claim_seq", "ends as bound_until")
    inside = (F.col("device_id") == F.col("_device")) & F.col("seq").between(
        F.col("claim_seq") + 1, F.col("bound_until") - 1)
    return rows.join(claims.hint("merge"), "slot", "left").join(mine.hint("merge"), inside, "left").selectExpr(
        *rows.columns, "coalesce(bound_slot, -1L) as bound_slot", "bound_slot is not null as inside",
        "claimer is null as free",
        "coalesce(claimer <> device_id and claimed_at < seq, false) as taken",
    ).withColumn("counts", F.expr("known and has_code and format_ok and not taken and not inside"))


def _settled(faced: DataFrame, earliest: DataFrame, heavy: Sequence) -> DataFrame:
    """How far each device's attempts are certain, and the claim it makes before that."""
    rival = f"coalesce(if(first_device = device_id, second_seq, first_seq), {NEVER}L)"
    rows = faced.join(earliest.withColumnRenamed("player_id", "slot").hint("merge"), "slot", "left").selectExpr(
        "device_id", "seq", "at", "slot", "ends", "counts", "code_ok", "free", f"not inside and {rival} < seq as open")
    found = walk_attempts(rows, heavy).groupBy("device_id").agg(
        F.expr(f"coalesce(min(if(open, seq, null)), {NEVER}L)").alias("horizon"),
        F.expr("min(struct(seq, slot, ends)) filter (where outcome = 'ok' and free)").alias("first"))
    return found.selectExpr(
        "device_id", "first.seq < horizon as claims", "first.slot as slot", "first.seq as claim_seq", "first.ends as ends",
        "if(first.seq < horizon, first.ends, horizon) as horizon")


_RESULT = """case
    when inside then if(bound_slot = slot, 'already_bound_here', 'device_already_bound')
    when not known then 'player_not_found'
    when taken then 'player_already_claimed'
    when outcome <> 'not_counted' then outcome
    when not has_code then 'code_not_configured'
    else 'invalid_code_format' end"""


def resolve_claims_over_time(
    attempts: DataFrame, players: DataFrame, log: DataFrame, heavy: Sequence | None = None
) -> DataFrame:
    """Result of every claim attempt where players are added, reset and taken out in between.

    ``seq`` orders attempts and log together.  Each round settles every device up to the first attempt that an
    unsettled claim of another device could still change, or to the end of the binding it makes before that;
    the earliest open claim is always settled, so the rounds end.  The joins are merged: a broadcast in every round
    would send what is settled through the driver each time.
    """
    heavy = heavy_devices(attempts) if heavy is None else heavy
    periods = materialize(player_periods(players, log), "player-periods")
    rows = materialize(_prepared(attempts, periods), "claims-as-of")
    bindings = materialize(_holders(periods), "bindings")
    horizons = rows.sparkSession.createDataFrame([], "device_id bigint, horizon bigint")
    while True:
        faced = _faced(rows, bindings)
        possible = faced.where("counts and code_ok and free").join(
            horizons.hint("merge"), "device_id", "left").where(
            "horizon is null or seq >= horizon").select(F.col("slot").alias("player_id"), "device_id", "seq")
        earliest = materialize(rivals(possible), "claim-rivals")
        if earliest.isEmpty():
            break
        settled = materialize(_settled(faced, earliest, heavy), "claim-settled")
        horizons = settled.select("device_id", "horizon")
        bindings = materialize(
            bindings.unionByName(settled.where("claims").select("device_id", "slot", "claim_seq", "ends")), "bindings")
    return walk_attempts(faced, heavy).selectExpr(
        "device_id", "seq", "nullif(player_id, -1L) as player_id", f"{_RESULT} as outcome")

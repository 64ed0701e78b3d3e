"""Player lookups: who is active, who may be named, who is bound to a device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC_COLUMNS = ["id", "display_name", "is_active", "created_at"]


def active_players(players: DataFrame) -> DataFrame:
    return players.where("is_active").select("id", "display_name").orderBy("display_name")


def candidate_targets(players: DataFrame, viewer_id) -> DataFrame:
    """Everybody the viewer may name, that is every active player but the viewer."""
    return (
        players.where(F.col("is_active") & (F.col("id") != viewer_id))
        .select("id", "display_name").orderBy("display_name")
    )


def public_players(players: DataFrame) -> DataFrame:
    """Visible rows and columns only: no code, no device."""
    return players.where("is_active").select(*PUBLIC_COLUMNS)


def with_active_flag(df: DataFrame, players: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a column telling whether ``key`` is the id of an active player."""
    active = players.where("is_active").select(F.col("id").alias(key), F.lit(True).alias(flag))
    joined = df.join(active, key, "left")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def with_player_name(
    df: DataFrame, players: DataFrame, key: str, name: str, default: str = "unknown"
) -> DataFrame:
    """Add the display name of an active player, or a default."""
    names = players.where("is_active").select(F.col("id").alias(key), F.col("display_name").alias(name))
    joined = df.join(names, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def bound_players(devices: DataFrame, players: DataFrame, device: str = "device_id") -> DataFrame:
    """The active player of each device; devices without one are left out."""
    bound = players.where(F.col("is_active") & F.col("claimed_user_id").isNotNull())
    # A device holds at most one active player by rule; the lowest id decides if data breaks it.
    one = bound.groupBy(F.col("claimed_user_id").alias(device)).agg(
        F.min(F.struct("id", "display_name")).alias("player")
    )
    return devices.select(device).distinct().join(one, device).select(
        device, F.col("player.id").alias("id"), F.col("player.display_name").alias("display_name")
    )


def bound_player(players: DataFrame, device_id) -> DataFrame:
    """At most one row: the active player of one device."""
    return (
        players.where(F.col("is_active") & (F.col("claimed_user_id") == device_id))
        .select("id", "display_name").orderBy("id").limit(1)
    )


def with_actor(commands: DataFrame, players: DataFrame) -> DataFrame:
    """Replace the device of each command by the player it acts for, or null."""
    bound = players.where(F.col("is_active") & F.col("claimed_user_id").isNotNull()).groupBy(
        F.col("claimed_user_id").alias("device_id")
    ).agg(F.min("id").alias("actor_id"))
    return commands.join(bound, "device_id", "left")


def latest_player_changes(changes: DataFrame) -> DataFrame:
    """State of each player name after its last change."""
    return changes.groupBy("display_name").agg(
        F.max_by(F.col("is_active"), F.struct("changed_at", "seq")).alias("is_active"),
        F.max("changed_at").alias("changed_at"),
        F.count("*").alias("changes"),
    )


def without_deleted(df: DataFrame, deleted: DataFrame, key: str, parent: str = "id") -> DataFrame:
    """Cascading delete: drop rows whose parent is in the delete set."""
    return df.join(deleted.select(F.col(parent).alias(key)).distinct(), key, "left_anti")


def null_deleted(df: DataFrame, deleted: DataFrame, key: str, parent: str = "id") -> DataFrame:
    """Set-null delete: keep rows, clear references into the delete set."""
    gone = deleted.select(F.col(parent).alias(key)).distinct().withColumn("_gone", F.lit(True))
    columns: list[Column] = [
        F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in df.columns
    ]
    return df.join(gone, key, "left").select(*columns)

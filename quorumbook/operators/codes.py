"""Unique random codes for the active players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumbook.functions.rules import CODE_DIGITS
from quorumbook.plans.numbering import numbered


ROUNDS = 4


def _permuted(number: Column, seed: str, digits: int) -> Column:
    """A seeded permutation of the numbers below 10^digits: each half of the digits is shifted by a hash of the other.

    A number's place depends on nothing but itself, so no list of codes is made, sorted or joined.
    """
    low = 10 ** (digits // 2)
    sizes = [10**digits // low, low]
    halves = [F.floor(number / low).cast("bigint"), F.pmod(number, F.lit(low))]
    for turn in range(ROUNDS):
        mine, other = turn % 2, 1 - turn % 2
        text = F.concat(F.lit(f"{seed}:{turn}:"), halves[other].cast("string"))
        shift = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
        halves[mine] = F.pmod(halves[mine] + F.pmod(shift, F.lit(sizes[mine])), F.lit(sizes[mine]))
    return halves[0] * low + halves[1]


def assign_codes(players: DataFrame, seed: str, digits: int = CODE_DIGITS) -> DataFrame:
    """Give the n-th active player the n-th code of a seeded random order.

    Refuses when there are more active players than codes.
    """
    active = players.where("is_active").select("id", "display_name")
    count, codes = active.count(), 10**digits
    if count > codes:
        raise ValueError(f"{count} active players need more than {codes} codes of {digits} digits")
    number = _permuted(F.col("row_number") - 1, seed, digits)
    return numbered(active, "id").select(
        "id", "display_name", F.lpad(number.cast("string"), digits, "0").alias("code")
    )


def refused_players(players: DataFrame, digits: int = CODE_DIGITS) -> DataFrame:
    """The active players when there are too few codes for all of them: nobody gets one then."""
    active = players.where("is_active")
    refused = active if active.count() > 10**digits else active.limit(0)
    return refused.select("id", F.lit("too_few_codes").alias("reason"))


def apply_codes(players: DataFrame, codes: DataFrame) -> DataFrame:
    """Give the players their new codes and clear the bindings of those who got one."""
    fresh = codes.select("id", "code")
    return players.join(fresh, "id", "left").selectExpr(
        *[c for c in players.columns if c not in ("claimed_user_id", "claimed_at", "has_code")],
        "if(code is null, claimed_user_id, null) as claimed_user_id",
        "if(code is null, claimed_at, null) as claimed_at",
        "code is not null or coalesce(has_code, false) as has_code",
        "code",
    )

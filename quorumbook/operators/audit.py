"""Integrity rules as audits: rows that break a rule, and one table of counts.

Row rules of a table are counted in one pass.  Key rules aggregate first, so a
repeated key is one row after the partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumbook.functions.rules import (
    MAX_AMOUNT, MAX_NAME, MAX_TEXT, MIN_AMOUNT, MIN_NAME, MIN_TEXT, PROPOSAL_TYPES, REQUIRED_VOTES_ALLOWED,
    STORED_STATES,
)
from quorumbook.functions.text import length_ok


def _broken(rule: Column) -> Column:
    """A rule passes on null, as a table check does."""
    return ~F.coalesce(rule, F.lit(True))


def stored_state_rule() -> Column:
    status = F.col("status")
    by, at, gone = F.col("approved_by"), F.col("approved_at"), F.col("withdrawn_at")
    return (
        ((status == "pending") & by.isNull() & at.isNull() & gone.isNull())
        | (
            (status == "approved") & by.isNotNull() & at.isNotNull() & gone.isNull()
            & (by != F.col("proposed_by")) & (by != F.col("target_id"))
        )
        | ((status == "withdrawn") & by.isNull() & at.isNull() & gone.isNotNull())
    )


PROPOSAL_RULES = (
    "proposal_description_length", "proposal_amount_range", "proposal_status_set", "proposal_self_target",
    "proposal_state_rule", "proposal_type_set", "proposal_required_votes_set", "proposal_pardon_amount",
    "proposal_required_columns",
)


def player_rules() -> dict[str, Column]:
    return {
        "player_name_length": _broken(length_ok(F.col("display_name"), MIN_NAME, MAX_NAME)),
        "player_required_columns": F.col("id").isNull() | F.col("display_name").isNull() | F.col("is_active").isNull(),
    }


def proposal_rules() -> dict[str, Column]:
    required = ["id", "target_id", "proposed_by", "description", "amount", "status", "created_at", "proposal_type",
                "required_votes", "deadline"]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    return {
        "proposal_description_length": _broken(length_ok(F.col("description"), MIN_TEXT, MAX_TEXT)),
        "proposal_amount_range": _broken(F.col("amount").between(MIN_AMOUNT, MAX_AMOUNT)),
        "proposal_status_set": _broken(F.col("status").isin(*STORED_STATES)),
        "proposal_self_target": _broken(F.col("proposed_by") != F.col("target_id")),
        "proposal_state_rule": _broken(stored_state_rule()),
        "proposal_type_set": _broken(F.col("proposal_type").isin(*PROPOSAL_TYPES)),
        "proposal_required_votes_set": _broken(F.col("required_votes").isin(*REQUIRED_VOTES_ALLOWED)),
        "proposal_pardon_amount": _broken((F.col("proposal_type") == "penalty") | (F.col("amount") == 1)),
        "proposal_required_columns": missing,
    }


def vote_rules() -> dict[str, Column]:
    columns = ["id", "proposal_id", "voter_id", "created_at"]
    return {"vote_required_columns": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])}


def breaking_rows(df: DataFrame, rule: Column) -> DataFrame:
    return df.where(rule)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values held by more than one row; null keys do not count."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(present).groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphan_keys(
    df: DataFrame, key: str, parents: DataFrame, parent: str = "id", rows: Column | None = None
) -> DataFrame:
    """References without a parent row, with the number of rows that hold them.

    ``rows`` sums up a count when the input is counted already.
    """
    counted = F.count("*") if rows is None else F.sum(rows)
    held = df.where(F.col(key).isNotNull()).groupBy(key).agg(counted.alias("rows"))
    return held.join(parents.select(F.col(parent).alias(key)), key, "left_anti")


def _rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules]
    return counts.select(F.inline(F.array(*pairs)))


def _one_count(rule: str, df: DataFrame, rows: Column | None = None) -> DataFrame:
    value = F.count("*") if rows is None else F.coalesce(F.sum(rows), F.lit(0))
    return df.agg(value.alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def audit_summary(players: DataFrame, proposals: DataFrame, votes: DataFrame) -> DataFrame:
    """Number of violations of every rule.

    Uniqueness rules count the keys that repeat, reference rules the rows that dangle.
    """
    # The votes are counted per pair once; three rules read that shuffle.
    pairs = votes.groupBy("proposal_id", "voter_id").agg(F.count("*").alias("rows"))
    parts = [
        _rule_counts(players, player_rules()),
        _rule_counts(proposals, proposal_rules()),
        _rule_counts(votes, vote_rules()),
        _one_count("player_name_unique", repeated_keys(players, "display_name")),
        _one_count("player_device_unique", repeated_keys(players, "claimed_user_id")),
        _one_count("player_key_unique", repeated_keys(players, "id")),
        _one_count("proposal_key_unique", repeated_keys(proposals, "id")),
        _one_count("vote_key_unique", repeated_keys(votes, "id")),
        _one_count("vote_once_per_proposal", pairs.where("rows > 1 and proposal_id is not null and voter_id is not null")),
    ]
    references = [
        ("proposal_target_exists", proposals, "target_id", players),
        ("proposal_proposer_exists", proposals, "proposed_by", players),
        ("proposal_approver_exists", proposals, "approved_by", players),
        ("vote_proposal_exists", pairs, "proposal_id", proposals),
        ("vote_voter_exists", pairs, "voter_id", players),
    ]
    for rule, rows, key, parents in references:
        counted = F.col("rows") if rows is pairs else None
        parts.append(_one_count(rule, orphan_keys(rows, key, parents, rows=counted), F.col("rows")))
    return reduce(DataFrame.unionByName, [p.withColumn("violations", F.col("violations").cast("bigint")) for p in parts])

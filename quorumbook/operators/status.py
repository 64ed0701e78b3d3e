"""The status view over stored proposals, its summary, and the legacy backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumbook.functions.rules import LEGACY_VOTES, derived_status, votes_for_amount, voting_deadline
from quorumbook.sources.tables import with_default

STATUS_COLUMNS = [
    "id", "target_id", "proposed_by", "description", "amount", "proposal_type", "required_votes", "deadline",
    "vote_count", "status", "approved_by", "approved_at", "withdrawn_at", "created_at",
]


def with_derived_status(resolved: DataFrame, as_of: Column) -> DataFrame:
    """Replace the stored state by open, approved, failed or withdrawn."""
    return resolved.withColumn(
        "status", derived_status(F.col("status"), F.col("deadline"), as_of)
    ).select(*STATUS_COLUMNS)


def status_view(stored: DataFrame, votes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The view over stored tables: votes counted per proposal, status derived on read."""
    counts = votes.groupBy(F.col("proposal_id").alias("id")).agg(F.count("*").cast("int").alias("vote_count"))
    joined = stored.join(counts, "id", "left").withColumn("vote_count", F.coalesce("vote_count", F.lit(0)))
    return with_derived_status(joined, F.current_timestamp() if as_of is None else as_of)


def status_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(F.col("status") == "approved").alias("approved_proposals"),
        F.count_if(F.col("status") == "open").alias("open_proposals"),
    )


def backfill_amount(proposals: DataFrame) -> DataFrame:
    """Proposals from before amounts existed are worth one."""
    return with_default(proposals, "amount", F.lit(1).cast("smallint"))


def backfill_legacy(proposals: DataFrame, as_of: Column) -> DataFrame:
    """Bring rows from before group voting up to the current columns.

    Undecided rows are withdrawn first, because the vote threshold reads the state.
    """
    for column, kind in (("proposal_type", "string"), ("required_votes", "smallint"), ("deadline", "timestamp")):
        if column not in proposals.columns:
            proposals = proposals.withColumn(column, F.lit(None).cast(kind))
    legacy = F.col("required_votes").isNull()
    undecided = legacy & (F.col("status") == "pending")
    rows = backfill_amount(proposals).withColumn("_undecided", undecided).withColumns({
        "proposal_type": F.coalesce("proposal_type", F.lit("penalty")),
        "status": F.when(F.col("_undecided"), "withdrawn").otherwise(F.col("status")),
        "withdrawn_at": F.when(F.col("_undecided"), as_of).otherwise(F.col("withdrawn_at")),
    })
    return rows.withColumns({
        "required_votes": F.coalesce("required_votes", F.when(
            F.col("status") == "approved", F.lit(LEGACY_VOTES).cast("smallint")
        ).otherwise(votes_for_amount(F.col("amount")))),
        "deadline": F.coalesce("deadline", voting_deadline(F.col("created_at"))),
    }).drop("_undecided")

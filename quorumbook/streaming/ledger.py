"""The ledger as a stream: outcomes, score events and totals per micro-batch.

Every micro-batch joins the new commands with those of proposals that are still
open, decides what event time allows with the batch operators, and carries the
rest over in a table.  Events come out in the order of their time: an approval at
the very instant of the watermark waits for the deadlines of the same instant.  A proposal is open for two minutes, so what is carried is
bounded by the traffic of that time.  Tables are written per batch id in the
shared folder; a batch that is run again overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorumbook.functions.rules import derived_status
from quorumbook.operators.ballots import resolve_proposals
from quorumbook.operators.scores import leaderboard, plan_stretches, player_sums, score_events
from quorumbook.plans.skew import heavy_keys

COMMANDS = (
    "kind string, id bigint, proposal_id bigint, actor_id bigint, target_id bigint, amount smallint, "
    "proposal_type string, required_votes smallint, created_at timestamp, deadline timestamp"
)
OUTCOMES = (
    "id bigint, proposed_by bigint, target_id bigint, amount smallint, proposal_type string, deadline timestamp, "
    "status string, vote_count int, approved_by bigint, approved_at timestamp, withdrawn_at timestamp"
)
REST = f"{COMMANDS}, n_open bigint, keep boolean"
EVENTS = "player_id bigint, delta int, event_at timestamp, proposal_id bigint"
TOTALS = "player_id bigint, total int, version bigint"
REJECTS = "kind string, id bigint, proposal_id bigint, actor_id bigint, created_at timestamp, reason string"
CLOCK = "watermark bigint"

_COMPACT_EVERY = 50
_BEGINNING = -(2**62)


def command_stream(
    proposals: DataFrame, votes: DataFrame, withdrawals: DataFrame, ticks: DataFrame | None = None
) -> DataFrame:
    """The three logs as one stream of commands.

    ``ticks`` (created_at), such as a rate source, let time pass while no command comes.
    """
    made = proposals.selectExpr(
        "'propose' as kind", "id", "id as proposal_id", "proposed_by as actor_id", "target_id", "amount",
        "proposal_type", "required_votes", "created_at", "deadline",
    )
    rest = "cast(null as bigint) as target_id, cast(null as smallint) as amount, cast(null as string) as proposal_type"
    rest = [*rest.split(", "), "cast(null as smallint) as required_votes", "created_at",
            "cast(null as timestamp) as deadline"]
    voted = votes.selectExpr("'vote' as kind", "id", "proposal_id", "voter_id as actor_id", *rest)
    undone = withdrawals.selectExpr("'withdraw' as kind", "id", "proposal_id", "actor_id", *rest)
    commands = made.unionByName(voted).unionByName(undone)
    if ticks is None:
        return commands
    empty = {c.split(" ")[0]: f"cast(null as {c.split(' ')[1]}) as {c.split(' ')[0]}" for c in COMMANDS.split(", ")}
    return commands.unionByName(ticks.selectExpr(*[c for n, c in (empty | {
        "kind": "'tick' as kind", "created_at": "created_at"}).items()]))


@dataclass(frozen=True)
class LedgerFolder:
    """Output tables of one ledger stream."""

    spark: SparkSession
    root: str
    compact_every: int = _COMPACT_EVERY

    def path(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def write(self, table: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(table, batch))

    def read(self, table: str, batch: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table, batch))

    def read_all(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/batch=*")

    def outcomes(self) -> DataFrame:
        return self.read_all("status", f"{OUTCOMES}, decided boolean").where("decided").drop("decided")

    def events(self) -> DataFrame:
        return self.read_all("events", EVENTS)

    def rejects(self) -> DataFrame:
        return self.read_all("rejects", REJECTS)

    def totals(self, versions: list[int]) -> DataFrame:
        paths = [self.path("totals", v) for v in versions]
        log = self.spark.read.schema(TOTALS).parquet(*paths)
        return log.groupBy("player_id").agg(F.max_by("total", "version").alias("total"))


def _versions(batch: int, compact_every: int) -> list[int]:
    """The last full copy of the totals and the changes since."""
    return list(range(batch - batch % compact_every, batch + 1))


def _instant(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def _decide(commands: DataFrame, players: DataFrame, watermark: Column) -> DataFrame:
    """Status of every known proposal when the watermark passes."""
    proposals = commands.where("kind = 'propose'").selectExpr(
        "id", "target_id", "actor_id as proposed_by", "amount", "proposal_type", "required_votes", "created_at",
        "deadline", "'pending' as status", "cast(null as bigint) as approved_by",
        "cast(null as timestamp) as approved_at", "cast(null as timestamp) as withdrawn_at",
    )
    votes = commands.where("kind = 'vote'").selectExpr("id", "proposal_id", "actor_id as voter_id", "created_at")
    undone = commands.where("kind = 'withdraw'").select("id", "proposal_id", "actor_id", "created_at")
    resolved = resolve_proposals(proposals, votes, undone, players, watermark)
    return resolved.withColumn("status", derived_status(F.col("status"), F.col("deadline"), watermark))


def _new_totals(folder: LedgerFolder, batch: int, events: DataFrame) -> DataFrame:
    """Totals of the players with new events, or of everybody when it is time to compact.

    From a total s the events lead to S + max(s, -M), with S their sum and M
    their lowest prefix sum.
    """
    change = player_sums(events, plan_stretches(events, heavy_keys(events, "player_id")))
    if batch == 0:
        before = folder.spark.createDataFrame([], "player_id bigint, total int")
    else:
        before = folder.totals(_versions(batch - 1, folder.compact_every))
    how = "full" if batch % folder.compact_every == 0 else "left"
    return change.join(before, "player_id", how).selectExpr(
        "player_id",
        "cast(if(sum is null, total, sum + greatest(coalesce(total, 0), -low)) as int) as total",
        f"{batch}L as version",
    )


def _together(jobs: list[Callable[[], None]]) -> None:
    """Run jobs from threads of their own; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def _ledger_batch(folder: LedgerFolder, players: DataFrame, delay_seconds: int, closing: bool = False):
    def run(new: DataFrame, batch: int) -> None:
        new = new.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            newest = new.agg(F.max(F.unix_micros("created_at"))).first()[0]
            before = _BEGINNING
            on_time = commands = new.where("kind <> 'tick' and created_at is not null")
            if batch > 0:
                before = folder.read("clock", batch - 1, CLOCK).first()[0]
                on_time = commands.where(F.col("created_at") > _instant(before)).unionByName(
                    folder.read("carried", batch - 1, COMMANDS)
                )
            watermark = before if newest is None else max(before, newest - delay_seconds * 1_000_000)
            status = _decide(on_time, players, _instant(watermark))
            # Deadlines of the watermark's own instant are still open; approvals of that instant wait for them.
            waits = F.lit(False) if closing else F.coalesce(F.col("approved_at") >= _instant(watermark), F.lit(False))
            folder.write("status", batch, status.select(
                *[c.split(" ")[0] for c in OUTCOMES.split(", ")], ((F.col("status") != "open") & ~waits).alias("decided")))
            status = folder.read("status", batch, f"{OUTCOMES}, decided boolean")
            decided = status.where("decided").drop("decided")
            # A command is carried over with every open proposal of its id; one lookup tells those, and ids not met here.
            here = status.groupBy(F.col("id").alias("proposal_id")).agg(F.expr("count_if(not decided) as n_open"))
            rest = on_time.join(here, "proposal_id", "left").withColumn(
                "keep", F.coalesce(F.col("n_open") > 0, F.lit(False)) | (F.col("created_at") > _instant(watermark))
            ).where("keep or n_open is null")
            folder.write("rest", batch, rest.select(*[c.split(" ")[0] for c in REST.split(", ")]))
            rest = folder.read("rest", batch, REST)
            carried = rest.where("keep").withColumn("copy", F.expr("explode(sequence(1L, greatest(n_open, 1L)))"))
            late = commands.where(F.col("created_at") <= _instant(before)).withColumn("reason", F.lit("late"))
            timeless = new.where("created_at is null").withColumn("reason", F.lit("no_time"))
            # What remains belongs to a proposal decided earlier, or to none.
            stray = rest.where("not keep").drop("keep", "n_open").withColumn("reason", F.lit("no_open_proposal"))
            columns = [c.split(" ")[0] for c in REJECTS.split(", ")]
            clock = folder.spark.range(1).select(F.lit(watermark).cast("bigint").alias("watermark"))

            def write_totals() -> None:
                folder.write("events", batch, score_events(decided))
                folder.write("totals", batch, _new_totals(folder, batch, folder.read("events", batch, EVENTS)))

            # Small tables that do not wait for each other: their jobs run side by side.
            _together([
                write_totals,
                lambda: folder.write("carried", batch, carried.drop("keep", "n_open", "copy")),
                lambda: folder.write("rejects", batch, late.unionByName(stray).unionByName(timeless).select(*columns)),
                lambda: folder.write("clock", batch, clock),
            ])
        finally:
            new.unpersist()

    return run


def start_ledger(
    commands: DataFrame,
    players: DataFrame,
    root: str,
    delay_seconds: int = 0,
    every: str | None = None,
    compact_every: int = _COMPACT_EVERY,
) -> tuple[StreamingQuery, LedgerFolder]:
    """Follow the command stream.

    ``every`` is the trigger interval, which also coalesces bursts of changes;
    without it the query works off what is there and stops.  Commands older than
    the newest one by more than the delay are late and go to the rejects table.
    """
    folder = LedgerFolder(commands.sparkSession, root, compact_every)
    writer = (
        commands.writeStream.foreachBatch(_ledger_batch(folder, players, delay_seconds))
        .option("checkpointLocation", f"{root}/checkpoint")
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(), folder


def close_ledger(folder: LedgerFolder, players: DataFrame, last_batch: int) -> int:
    """A last batch without commands, for a log that has ended: what waited at the watermark comes out."""
    _ledger_batch(folder, players, 0, closing=True)(folder.spark.createDataFrame([], COMMANDS), last_batch + 1)
    return last_batch + 1


def stream_board(folder: LedgerFolder, players: DataFrame, last_batch: int) -> DataFrame:
    """The leaderboard after a batch."""
    return leaderboard(players, folder.totals(_versions(last_batch, folder.compact_every)))

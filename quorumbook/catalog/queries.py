"""Named queries over one folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumbook.functions.text import (
    code_format_ok, digits_prefix, first_match_class, length_ok, name_initial, number_or,
)
from quorumbook.functions.timing import duration_parts
from quorumbook.operators import audit, ballots, changes, claims, codes, feeds, resets, scores, throttle, timeline
from quorumbook.operators import players as people
from quorumbook.operators import proposals as admission
from quorumbook.operators import status as st
from quorumbook.plans.skew import order_bounds, piece_of
from quorumbook.plans.workspace import fresh_path, materialize
from quorumbook.sources.fixtures import (
    Fixtures, at_second, attempts_from_events, proposals_from_orders, votes_from_lines, withdrawals_from_orders,
)
from quorumbook.sources.functions import register_functions
from quorumbook.sources.schemas import CLAIM_ATTEMPTS, TEST_TABLES
from quorumbook.sources.tables import append_accepted, follow_table, inline_players, read_table
from quorumbook.sources.views import register_views
from quorumbook.streaming.cases import case_rejects, event_log, follow_cases, outcomes
from quorumbook.streaming.changes import follow_changes
from quorumbook.streaming.ledger import (
    LedgerFolder, close_ledger, command_stream, start_ledger, stream_board,
)
from quorumbook.streaming.matching import match_votes, remaining_matches
from quorumbook.streaming.sinks import drain
from quorumbook.streaming.throttle import stream_throttle as throttled_stream
from quorumbook.streaming.throttle import throttle_rejects
from quorumbook.streaming.totals import follow_histogram, follow_totals, latest_totals, ranked_totals

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters of the single-player queries.
VIEWER = 83
HISTORY_PLAYER = 2
DEVICE = 7
INLINE_NAMES = [f"Customer#{number:09}" for number in (7, 3, 5, 83)]
CODE_SEED = "spring"
CODE_WIDTH = 6
# Micro-batches of the registered streams at least, and after how many the totals are written in full.
SLICES, COMPACT_EVERY = 5, 3
ROWS_PER_SLICE, ROWS_PER_FILE, FILES_PER_SLICE = 20_000_000, 250_000, 4
# Slices for each of which a log is read once more.
SLICES_PER_PART = 16
# Seconds for which the registered streams with late commands keep what they may correct: ten years.
LATENESS = 315_360_000
# Proposals or devices, by consecutive ids, that share an entry of state in the registered streams, and proposals or
# players that do where their rows come packed.
NEIGHBOURS, PACKED_NEIGHBOURS = 64, 2048


def plain(df: DataFrame) -> DataFrame:
    """Times as microseconds since 1970 and small integers as int, for comparison across engines."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.ShortType):
            c = c.cast("int")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(run: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    REGISTRY[run.__name__] = lambda spark, folder: plain(run(Fixtures(spark, folder)))
    return run


def _decided(fx: Fixtures) -> DataFrame:
    return ballots.decisions(fx.proposals, fx.votes, fx.withdrawals, fx.players, fx.as_of)


def _status(fx: Fixtures, cutoff: Column | None = None) -> DataFrame:
    """Status of all proposals, or of those created since the cutoff."""
    resolved = ballots.resolve_proposals(
        feeds.since(fx.proposals, cutoff), feeds.since(fx.votes, cutoff), feeds.since(fx.withdrawals, cutoff),
        fx.players, fx.as_of,
    )
    return st.with_derived_status(resolved, fx.as_of)


def _feed_status(fx: Fixtures) -> DataFrame:
    return _status(fx, feeds.feed_cutoff(fx.proposals, fx.withdrawals, fx.as_of))


def _open_status(fx: Fixtures) -> DataFrame:
    return _status(fx, feeds.open_since(fx.as_of))


def _open_votes(fx: Fixtures) -> DataFrame:
    """Accepted votes on proposals that may be open."""
    cutoff = feeds.open_since(fx.as_of)
    return ballots.accepted_votes(ballots.decisions(
        feeds.since(fx.proposals, cutoff), feeds.since(fx.votes, cutoff), feeds.since(fx.withdrawals, cutoff),
        fx.players, fx.as_of,
    ))


def _board(fx: Fixtures) -> DataFrame:
    events, cuts = scores.prepared_events(_status(fx), fx.proposals)
    return scores.leaderboard(fx.players, scores.player_totals(events, cuts))


# Seconds between the instants of the leaderboard over time.
GRID_SECONDS = 3600

# Tables -------------------------------------------------------------------

@query
def fx_players(fx):
    return fx.players


@query
def fx_proposals(fx):
    return fx.proposals.select(
        "id", "target_id", "proposed_by", "description", "amount", "proposal_type", "required_votes", "created_at",
        "deadline",
    )


@query
def fx_votes(fx):
    return fx.votes.select("proposal_id", "voter_id", "created_at")


@query
def fx_withdrawals(fx):
    return fx.withdrawals.select("proposal_id", "actor_id", "created_at")


@query
def active_players(fx):
    return people.active_players(fx.players)


@query
def players_by_inline_names(fx):
    """The players whose names are given as literals, in the order given."""
    given = inline_players(fx.spark, INLINE_NAMES).selectExpr("id as place", "display_name")
    return fx.players.join(F.broadcast(given), "display_name").select("place", "id", "display_name", "is_active")


@query
def candidate_targets(fx):
    return people.candidate_targets(fx.players, VIEWER)


@query
def public_players(fx):
    return people.public_players(fx.players)


@query
def name_initials(fx):
    return fx.players.where("is_active").select("id", name_initial(F.col("display_name")).alias("initial"))


@query
def player_change_log_latest(fx):
    return people.latest_player_changes(fx.player_changes)


@query
def cascade_votes(fx):
    gone = fx.stored_proposals.where(F.col("status") == "withdrawn")
    return people.without_deleted(fx.votes, gone, "proposal_id").select("proposal_id", "voter_id", "created_at")


@query
def clear_deleted_devices(fx):
    """Device bindings are cleared when the device's account was removed (its last event is an error)."""
    last = fx.raw("events").groupBy(F.col("user_id").alias("id")).agg(
        F.max_by("event_type", "event_id").alias("last")
    )
    return people.null_deleted(fx.players, last.where(F.col("last") == "error"), "claimed_user_id").select(
        "id", "claimed_user_id"
    )


@query
def bound_players(fx):
    devices = fx.raw("events").select(F.col("user_id").alias("device_id"))
    return people.bound_players(devices, fx.players)


@query
def bound_player(fx):
    return people.bound_player(fx.players, DEVICE)


# Scoring ------------------------------------------------------------------

@query
def proposal_status(fx):
    return _status(fx)


@query
def status_view(fx):
    stored = st.backfill_legacy(fx.stored_proposals, fx.as_of)
    return st.status_view(stored, ballots.accepted_votes(_decided(fx)), fx.as_of)


@query
def sql_functions(fx):
    """Each device's player and the replies to the player's votes, by functions called in SQL."""
    register_functions(fx.players, fx.proposals, fx.votes, fx.withdrawals, fx.as_of, prefix="fn_")
    fx.raw("events").select(F.col("user_id").alias("device_id")).distinct().createOrReplaceTempView("fn_devices")
    return fx.spark.sql("""
        SELECT d.device_id, p.id, p.display_name, r.proposal_id, r.created_at, r.receipt,
               fn_claimed_player_id(d.device_id) AS player_id
        FROM fn_devices d, LATERAL fn_claimed_player(d.device_id) p, LATERAL fn_replies_to(p.id) r""")


@query
def sql_over_views(fx):
    """A statement over the registered views: open and decided cases of the players with points."""
    stored = st.backfill_legacy(fx.stored_proposals, fx.as_of)
    register_views(fx.players, stored, ballots.accepted_votes(_decided(fx)), fx.as_of, prefix="ledger_")
    return fx.spark.sql("""
        select l.id, l.display_name, l.total, count(s.id) as cases, count_if(s.status = 'open') as open_cases
        from ledger_leaderboard l left join ledger_proposal_status s on s.target_id = l.id
        where l.total > 0 group by l.id, l.display_name, l.total""")


@query
def status_summary(fx):
    return st.status_summary(_status(fx))


@query
def score_events(fx):
    return scores.score_events(_status(fx))


@query
def score_history(fx):
    events, cuts = scores.prepared_events(_status(fx), fx.proposals)
    return scores.score_history(events, cuts)


@query
def leaderboard(fx):
    return _board(fx)


@query
def leaderboard_v1(fx):
    return scores.leaderboard_v1(fx.players, st.backfill_amount(fx.stored_proposals))


@query
def ranked_leaderboard(fx):
    return scores.ranked_leaderboard(_board(fx))


# Commands -----------------------------------------------------------------

@query
def leaderboard_over_time(fx):
    """The leaderboard at every full hour of the log."""
    last = fx.raw("orders").agg(F.max("o_orderkey")).first()[0] or 0
    grid = fx.spark.range(1, last * 7 // GRID_SECONDS + 1).select(
        at_second(F.col("id") * GRID_SECONDS).alias("instant"))
    # Resolved once: the events and which of them are approvals are read from the same narrow table.
    status = materialize(_status(fx).select(
        "id", "status", "proposal_type", "target_id", "proposed_by", "amount", "approved_at", "deadline"), "status")
    return timeline.leaderboard_over_time(fx.players, status, scores.score_events(status), grid)


@query
def classify_votes(fx):
    return ballots.classify_votes(fx.proposals, fx.votes, fx.withdrawals, fx.players, fx.as_of).drop("id")


@query
def classify_votes_redelivered(fx):
    """Every tenth vote arrives twice under the same id."""
    again = fx.votes.where(F.col("proposal_id") % 10 == 0)
    twice = fx.votes.unionByName(again)
    return ballots.classify_votes(fx.proposals, twice, fx.withdrawals, fx.players, fx.as_of).drop("id")


@query
def second_votes(fx):
    """Votes by the older name of the command."""
    return ballots.second_proposals(fx.proposals, fx.votes, fx.withdrawals, fx.players, fx.as_of).drop("id")


@query
def approval_moment(fx):
    return ballots.approval_moments(_decided(fx))


@query
def vote_receipts_json(fx):
    classified = ballots.classify_votes(fx.proposals, fx.votes, fx.withdrawals, fx.players, fx.as_of)
    return ballots.vote_receipts(classified).drop("id")


@query
def classify_withdrawals(fx):
    return ballots.classify_withdrawals(fx.proposals, fx.votes, fx.withdrawals, fx.players, fx.as_of).drop("id")


@query
def classify_proposals(fx):
    return admission.classify_proposals(fx.proposal_commands, fx.players).drop("description")


@query
def append_proposals(fx):
    """Commands appended to a table in two deliveries, as the table holds them afterwards."""
    path = fresh_path(fx.spark, "appended")
    columns = ["id", "actor_id", "target_id", "proposal_type", "amount"]
    judged = admission.classify_proposals(fx.proposal_commands, fx.players)
    returned = [append_accepted(judged.where(part), path, columns) for part in ("id % 2 = 0", "id % 2 = 1")]
    return read_table(fx.spark, path, returned[0].schema)


@query
def classify_device_proposals(fx):
    """The actor of each command is whoever is bound to the sending device."""
    commands = people.with_actor(
        fx.proposal_commands.withColumnRenamed("actor_id", "device_id"), fx.players
    )
    return admission.classify_proposals(commands, fx.players).select("id", "actor_id", "outcome", "required_votes")


@query
def classify_proposals_v1(fx):
    commands = fx.proposal_commands.drop("amount", "proposal_type")
    return admission.classify_proposals(commands, fx.players, voting=False).select(
        "id", "actor_id", "target_id", "text_length", "amount", "required_votes", "outcome"
    )


@query
def v1_outcomes(fx):
    first = ballots.under_first_rules(fx.proposals)
    return ballots.resolve_proposals(first, fx.votes, fx.withdrawals, fx.players, fx.as_of).select(
        "id", "status", "approved_by", "approved_at", "withdrawn_at"
    )


# Feeds --------------------------------------------------------------------

@query
def recent_feed(fx):
    return feeds.recent_proposals(_feed_status(fx)).select("id", "status", "vote_count", "created_at")


@query
def pending_feed(fx):
    return feeds.pending_feed(feeds.recent_proposals(_open_status(fx), limit=None), fx.players, fx.as_of)


@query
def open_count(fx):
    return feeds.open_count(feeds.recent_proposals(_open_status(fx), limit=None))


@query
def history_feed(fx):
    return feeds.history_feed(feeds.recent_proposals(_feed_status(fx)), fx.players)


@query
def history_feed_player(fx):
    return feeds.history_feed(feeds.recent_proposals(_feed_status(fx)), fx.players, HISTORY_PLAYER)


@query
def player_history(fx):
    """Every decided case of one player, without the cut of the feed."""
    proposals = feeds.concerning(fx.proposals, HISTORY_PLAYER)
    votes = ballots.commands_on(fx.votes, proposals)
    resolved = ballots.resolve_proposals(
        proposals, votes, ballots.commands_on(fx.withdrawals, proposals), fx.players, fx.as_of
    )
    everything = feeds.recent_proposals(st.with_derived_status(resolved, fx.as_of), limit=None)
    return feeds.history_feed(everything, fx.players, HISTORY_PLAYER)


@query
def viewer_actions(fx):
    return feeds.viewer_actions(feeds.recent_proposals(_open_status(fx), limit=None), _open_votes(fx), VIEWER)


@query
def involved_actions(fx):
    return feeds.involved_actions(_open_status(fx), _open_votes(fx))


@query
def viewer_set_actions(fx):
    """What each of a set of viewers may do, as counts of open cases."""
    viewers = fx.players.select(F.col("id").alias("viewer_id"))
    return feeds.actions_of(_open_status(fx), _open_votes(fx), viewers)


@query
def voters_by_proposal(fx):
    return ballots.voters_by_proposal(_decided(fx))


@query
def outcome_label(fx):
    return feeds.outcome_labels(_status(fx))


# Audit and backfill ---------------------------------------------------------

def _repeated(df: DataFrame, which: str) -> DataFrame:
    """Some rows twice, so that their keys repeat."""
    return df.withColumn("_copy", F.explode(F.expr(f"if({which}, array(1, 2), array(1))"))).drop("_copy")


def _audited(fx: Fixtures) -> DataFrame:
    """Raw proposal rows as stored without any admission check, some of them broken on purpose.

    The long texts join last, when rows go to no other shuffle.
    """
    commands = fx.untold_commands.select("id", "doc_id", "amount", "target_id")
    broken = {
        "status": "if(id % 13 = 0, 'closed', status)",
        "proposal_type": "if(id % 17 = 0, 'bonus', proposal_type)",
        "required_votes": "if(id % 19 = 0, 3, required_votes)",
        "approved_by": "if(id % 23 = 0, -1, approved_by)",
    }
    stored = fx.stored_proposals.drop("description", "amount", "target_id").withColumns(
        {name: F.expr(rule) for name, rule in broken.items()}
    )
    return fx.with_description(_repeated(stored.join(commands, "id"), "id % 37 = 0"))


def _audited_players(fx: Fixtures) -> DataFrame:
    """Players, some of them with a blank name or a device that another one holds, and some twice."""
    return _repeated(fx.players.withColumns({
        "display_name": F.expr("if(id % 29 = 0, ' ', display_name)"),
        "claimed_user_id": F.expr("if(id % 31 = 0, id - 1, claimed_user_id)"),
    }), "id % 41 = 0")


@query
def audit_summary(fx):
    return audit.audit_summary(_audited_players(fx), _audited(fx), _repeated(fx.votes, "proposal_id % 43 = 0"))


def _register_row_audit(rule: str) -> None:
    def run(fx):
        rows = _audited(fx)
        return audit.breaking_rows(rows, audit.proposal_rules()[rule]).select("id")
    run.__name__ = f"audit_{rule}"
    query(run)


for _rule in audit.PROPOSAL_RULES:
    _register_row_audit(_rule)


@query
def audit_player_name_length(fx):
    return audit.breaking_rows(_audited_players(fx), audit.player_rules()["player_name_length"]).select("id")


@query
def audit_player_name_unique(fx):
    changes = fx.player_changes
    return audit.repeated_keys(changes, "display_name")


@query
def audit_player_device_unique(fx):
    return audit.repeated_keys(_audited_players(fx), "claimed_user_id")


@query
def audit_vote_once_per_proposal(fx):
    return audit.repeated_keys(fx.votes, "proposal_id", "voter_id")


@query
def audit_vote_voter_exists(fx):
    return audit.orphan_keys(fx.votes, "voter_id", fx.players.where("is_active"))


@query
def audit_vote_proposal_exists(fx):
    kept = fx.stored_proposals.where(F.col("status") != "withdrawn")
    return audit.orphan_keys(fx.votes, "proposal_id", kept)


@query
def backfill_legacy(fx):
    return st.backfill_legacy(fx.stored_proposals, fx.as_of).select(
        "id", "amount", "status", "proposal_type", "required_votes", "deadline", "withdrawn_at"
    )


@query
def backfill_amount(fx):
    return st.backfill_amount(fx.stored_proposals).select("id", "amount")


# Binding ---------------------------------------------------------------------

@query
def claim_throttle(fx):
    return throttle.claim_throttle(fx.claim_attempts)


@query
def claim_resolution(fx):
    return claims.resolve_claims(fx.claim_attempts, fx.unclaimed_players)


@query
def claim_receipts_json(fx):
    resolved = claims.resolve_claims(fx.claim_attempts, fx.unclaimed_players)
    return claims.claim_receipts(resolved, fx.players)


@query
def player_resets(fx):
    return resets.players_now(resets.player_periods(fx.players_at_start, fx.organiser_log))


@query
def claims_after_reset(fx):
    return resets.resolve_claims_over_time(fx.attempts_between, fx.players_at_start, fx.organiser_log)


def _codes(fx: Fixtures) -> DataFrame:
    return codes.assign_codes(fx.players, CODE_SEED, CODE_WIDTH)


@query
def assign_codes(fx):
    return _codes(fx)


@query
def apply_codes(fx):
    return codes.apply_codes(fx.players, _codes(fx)).select("id", "claimed_user_id", "claimed_at", "has_code", "code")


@query
def codes_refused(fx):
    """Two digits are too few for the players of the test tables."""
    return codes.refused_players(fx.players)


# Streams -----------------------------------------------------------------------

def _feed(fx: Fixtures, name: str) -> DataFrame:
    """One of the given tables as a stream of files."""
    return follow_table(fx.spark, fx.folder, TEST_TABLES[name], f"{name}.parquet")


def _delivered(fx: Fixtures, log: DataFrame, column: str, label: str, last: Column | None = None) -> DataFrame:
    """A log as a stream that delivers it in slices of time, one micro-batch each, and the rows of ``last`` at the end.

    Each slice is written once, into as many files as its rows ask for.  The log is read for every slice as long as these
    are few, which costs less than writing it twice; otherwise it is cut into parts of so many slices first.
    """
    at = F.unix_micros(column)
    rows = log.count()
    slices = max(SLICES, rows // ROWS_PER_SLICE)
    files = max(FILES_PER_SLICE, rows // slices // ROWS_PER_FILE)
    bounds = order_bounds(log.select(at.alias("at")), "at", slices)
    path, staged = fresh_path(fx.spark, label), None
    in_time = F.lit(True) if last is None else ~F.coalesce(last, F.lit(False))
    # What has no time comes with the first slice.
    taken = [in_time & F.coalesce(low & high, F.lit(number == 0)) for number, (low, high) in enumerate(zip(
        [F.lit(True), *[at > b for b in bounds]], [*[at <= b for b in bounds], F.lit(True)]))]
    taken += [] if last is None else [~in_time]
    if len(taken) > SLICES_PER_PART:
        staged = fresh_path(fx.spark, f"{label}-staged")
        starts = bounds[SLICES_PER_PART - 1::SLICES_PER_PART]
        part = F.when(in_time, piece_of(at, starts)).otherwise((len(taken) - 1) // SLICES_PER_PART)
        log.withColumn("part", part).write.partitionBy("part").parquet(staged)
    # Files are taken in the order in which they were written.
    for number, rows_taken in enumerate(taken):
        part = log if staged is None else fx.spark.read.schema(log.schema).parquet(
            f"{staged}/part={number // SLICES_PER_PART}")
        part.where(rows_taken).repartition(files).write.mode("append").parquet(path)
    return follow_table(fx.spark, path, log.schema, files_per_trigger=files)


def _ledger_stream(fx: Fixtures) -> tuple[LedgerFolder, int]:
    stream = _delivered(fx, command_stream(fx.proposals, fx.votes, fx.withdrawals), "created_at", "commands")
    running, folder = start_ledger(stream, fx.players, fresh_path(fx.spark, "ledger"), compact_every=COMPACT_EVERY)
    running.awaitTermination()
    return folder, close_ledger(folder, fx.players, running.lastProgress["batchId"])


@query
def stream_proposal_outcomes(fx):
    return _ledger_stream(fx)[0].outcomes().select("id", "status", "vote_count", "approved_by", "approved_at")


@query
def stream_score_events(fx):
    return _ledger_stream(fx)[0].events()


@query
def stream_leaderboard(fx):
    folder, last = _ledger_stream(fx)
    return stream_board(folder, fx.players, last)


@query
def stream_proposal_state(fx):
    """The outcomes from keyed state per proposal, over the same slices as the ledger."""
    commands = _delivered(fx, command_stream(fx.proposals, fx.votes, fx.withdrawals), "created_at", "commands")
    given = drain(follow_cases(commands, fx.players, neighbours=PACKED_NEIGHBOURS), "cases-log")
    return outcomes(given).select("id", "status", "vote_count", "approved_by", "approved_at")


@query
def stream_late_commands(fx):
    """Commands that are refused as late, where those of every tenth player are delivered after all others."""
    commands = command_stream(fx.proposals, fx.votes, fx.withdrawals)
    stream = _delivered(fx, commands, "created_at", "commands", F.col("actor_id") % 10 == 7)
    given = drain(follow_cases(stream, fx.players, neighbours=PACKED_NEIGHBOURS), "cases-log")
    return case_rejects(given).where("reason = 'late'").drop("id")


@query
def stream_scores_late(fx):
    """The leaderboard where every tenth command is delivered after all others, and corrects what it changes."""
    commands = command_stream(fx.proposals, fx.votes, fx.withdrawals)
    late = F.pmod(F.xxhash64("kind", "id"), F.lit(10)) == 0
    stream = _delivered(fx, commands, "created_at", "commands", late)
    events = event_log(follow_cases(stream, fx.players, lateness_seconds=LATENESS, neighbours=PACKED_NEIGHBOURS))
    given = drain(follow_totals(events, neighbours=PACKED_NEIGHBOURS), "totals-log")
    return scores.leaderboard(fx.players, latest_totals(given))


@query
def stream_ranks(fx):
    """Ranks read from a histogram of totals that differences keep current."""
    stream = _delivered(fx, command_stream(fx.proposals, fx.votes, fx.withdrawals), "created_at", "commands")
    root = fresh_path(fx.spark, "totals-log")
    events = event_log(follow_cases(stream, fx.players, neighbours=PACKED_NEIGHBOURS))
    totals = drain(follow_totals(events, neighbours=PACKED_NEIGHBOURS), "totals-log", root)
    histogram = drain(follow_histogram(follow_table(fx.spark, f"{root}/rows", totals.schema), fx.players), "histogram-log")
    return ranked_totals(totals, histogram, fx.players)


@query
def stream_changes(fx):
    """The view over the whole change log as the stream leaves it."""
    given = drain(
        follow_changes(_delivered(fx, fx.changes, "changed_at", "changes"), neighbours=NEIGHBOURS), "changes-log")
    return changes.standing_rows(given)


@query
def view_after_changes(fx):
    last = fx.changes.agg(F.max("changed_at")).first()[0]
    return changes.view_after(fx.changes, F.lit(last))


@query
def stream_throttle(fx):
    attempts = attempts_from_events(_feed(fx, "events"), fx.player_count)
    return drain(throttled_stream(attempts, neighbours=NEIGHBOURS), "throttle").withColumnRenamed("at", "ts")


@query
def stream_rejects(fx):
    """Late attempts, where every tenth attempt is delivered after all others."""
    path, root = fresh_path(fx.spark, "delivered"), fresh_path(fx.spark, "rejects")
    for delivered in ("seq % 10 <> 0", "seq % 10 = 0"):
        fx.claim_attempts.where(delivered).write.mode("append").parquet(path)
        stream = follow_table(fx.spark, path, CLAIM_ATTEMPTS)
        rejected = drain(throttle_rejects(stream, neighbours=NEIGHBOURS), "rejects", root)
    return rejected.withColumnRenamed("at", "ts")


@query
def stream_vote_match(fx):
    matched = match_votes(
        proposals_from_orders(_feed(fx, "orders"), fx.player_count),
        votes_from_lines(_feed(fx, "lineitem"), fx.player_count),
        neighbours=PACKED_NEIGHBOURS,
    )
    streamed = drain(matched, "vote-match")
    return streamed.unionByName(remaining_matches(streamed, fx.proposals, fx.votes)).drop("id")


# Text and time ---------------------------------------------------------------

@query
def text_length_rule(fx):
    text = F.col("text")
    return fx.raw("conversations").select(
        "conv_id", "turn", F.char_length(F.trim(text)).alias("text_length"), length_ok(text).alias("is_ok")
    )


@query
def document_length_rule(fx):
    text = F.col("text")
    return fx.raw("documents").select(
        "doc_id", F.char_length(F.trim(text)).alias("text_length"), length_ok(text).alias("is_ok")
    )


@query
def digits_prefix_of_text(fx):
    return fx.raw("conversations").select("conv_id", "turn", digits_prefix(F.col("text")).alias("digits"))


# Keyword rules for the test texts: every group needs one of its words, the first matching class wins.
TEXT_CLASSES = [
    ("secret", [["password", "token"], ["="]]),
    ("address", [["@"], ["example"]]),
    ("licence", [["license"], ["gnu", "mit", "apache", "creative"]]),
    ("table", [[" | "]]),
    ("rude", [["idiot", "pathetic", "worthless"]]),
]


@query
def code_format(fx):
    """Codes as typed into a two-digit field, from the digits of a text."""
    code = digits_prefix(F.col("props"))
    return fx.raw("events").select(
        "event_id", code.alias("code"), code_format_ok(code).alias("is_ok"), number_or(code, 1).alias("number")
    )


@query
def text_class(fx):
    return fx.raw("documents").select("doc_id", first_match_class(F.col("text"), TEXT_CLASSES).alias("class"))


@query
def duration_parts_left(fx):
    """Time from each event to a fixed departure, as days, hours and minutes."""
    departure = at_second(F.lit(0))
    parts = duration_parts(F.col("changed_at"), departure)
    return fx.player_changes.select("seq", *[c.alias(name) for name, c in parts.items()])

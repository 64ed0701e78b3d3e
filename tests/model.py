"""The rules one command at a time, in plain Python, for small logs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
WINDOW = 15 * 60 * 1_000_000


def at(second: float) -> datetime:
    return BASE + timedelta(seconds=second)


def replay(proposals, votes, withdrawals, active, as_of):
    """Vote and withdrawal outcomes by id, and the final state of each proposal.

    proposals: id -> dict(proposer, target, needed, created, deadline)
    votes and withdrawals: lists of (id, proposal, actor, second)
    """
    state = {i: dict(status="pending", votes=[], at=None, by=None) for i, p in proposals.items() if p["created"] <= as_of}
    commands = [(s, 1, actor, i, p) for i, p, actor, s in votes if s <= as_of]
    commands += [(s, 0, actor, i, p) for i, p, actor, s in withdrawals if s <= as_of]
    vote_out, gone_out = {}, {}
    for second, kind, actor, i, p in sorted(commands):
        rule, now = proposals.get(p), state.get(p)
        known = now is not None and rule["created"] <= second
        if kind == 0:
            if actor not in active:
                gone_out[i] = "no_identity"
            elif (known and now["status"] == "pending" and second <= rule["deadline"] and actor == rule["proposer"]
                  and not now["votes"]):
                gone_out[i] = "accepted"
                now.update(status="withdrawn", at=second)
            else:
                gone_out[i] = "refused"
            continue
        if actor not in active:
            vote_out[i] = "no_identity"
        elif not known:
            vote_out[i] = "not_found"
        elif now["status"] != "pending":
            vote_out[i] = "already_decided"
        elif second > rule["deadline"]:
            vote_out[i] = "past_deadline"
        elif actor in (rule["proposer"], rule["target"]):
            vote_out[i] = "not_eligible"
        elif actor in now["votes"]:
            vote_out[i] = "duplicate"
        else:
            vote_out[i] = "accepted"
            now["votes"].append(actor)
            if len(now["votes"]) >= rule["needed"]:
                now.update(status="approved", at=second, by=actor)
    for p, now in state.items():
        if now["status"] == "pending":
            now["status"] = "failed" if as_of > proposals[p]["deadline"] else "open"
    return vote_out, gone_out, state


def totals(proposals, state):
    """Floored totals after each event, and the last one per player."""
    events = []
    for i, now in state.items():
        p = proposals[i]
        if now["status"] == "approved":
            delta = p["amount"] if p["kind"] == "penalty" else -1
            events.append((p["target"], now["at"], i, delta))
        elif now["status"] == "failed" and p["kind"] == "penalty":
            events.append((p["proposer"], p["deadline"], i, p["amount"]))
    history, last = {}, {}
    for player, _, i, delta in sorted(events):
        last[player] = max(last.get(player, 0) + delta, 0)
        history[i] = last[player]
    return history, last


def random_log(seed: int, n_proposals=40, n_players=12, n_votes=600, hot=None):
    """A busy random log; ``hot`` names a proposal and a player that get a third of everything."""
    rng = random.Random(seed)
    active = {p for p in range(n_players) if p % 5 != 4}
    proposals = {}
    for i in range(n_proposals):
        proposer, target = rng.sample(range(n_players), 2)
        if hot and rng.random() < 0.4:
            target, proposer = (0, proposer) if proposer != 0 else (0, 1)
        kind = rng.choice(["penalty", "penalty", "pardon"])
        amount = 1 if kind == "pardon" else rng.randint(1, 3)
        needed = 8 if kind == "pardon" else {1: 2, 2: 4, 3: 8}[amount]
        created = rng.randrange(0, 400, 5)
        proposals[i] = dict(proposer=proposer, target=target, kind=kind, amount=amount, needed=needed,
                            created=created, deadline=created + 120)
    votes, gone = [], []
    for i in range(n_votes):
        p = 0 if hot and rng.random() < 0.35 else rng.randrange(n_proposals + 2)
        start = proposals.get(p, {"created": 0})["created"]
        voter = 1 if hot and rng.random() < 0.5 else rng.randrange(n_players)
        votes.append((i, p, voter, start + rng.randrange(-10, 150, 5)))
    for i in range(n_proposals):
        p = rng.randrange(n_proposals)
        actor = proposals[p]["proposer"] if rng.random() < 0.8 else rng.randrange(n_players)
        gone.append((i, p, actor, proposals[p]["created"] + rng.randrange(-5, 140, 5)))
    return proposals, votes, gone, active, n_players


def throttle(attempts):
    """Outcome by seq; attempts are (device, seq, micros, well_formed, right)."""
    state, out = {}, {}
    for device, seq, now, well_formed, right in sorted(attempts, key=lambda a: (a[2], a[1])):
        n, started, blocked = state.get(device, (0, None, None))
        if blocked is not None and blocked > now:
            out[seq] = "temporarily_blocked"
        elif not well_formed:
            out[seq] = "invalid_code_format"
        elif right:
            out[seq] = "ok"
            state.pop(device, None)
        else:
            out[seq], state[device] = count_wrong(n, started, now)
    return out


def count_wrong(n, started, now):
    if started is None or started < now - WINDOW:
        n, started = 1, now
    else:
        n += 1
    if n >= 5:
        return "locked_now", (n, started, now + WINDOW)
    return "invalid_code", (n, started, None)


def claims(attempts, players):
    """Result by seq; players: id -> dict(active, has_code, owner)."""
    owner = {p: v["owner"] for p, v in players.items()}
    state, out = {}, {}
    for device, seq, now, player, well_formed, right in sorted(attempts, key=lambda a: a[1]):
        mine = [p for p, d in owner.items() if d == device and players[p]["active"]]
        n, started, blocked = state.get(device, (0, None, None))
        if mine:
            out[seq] = "already_bound_here" if player in mine else "device_already_bound"
        elif player not in players or not players[player]["active"]:
            out[seq] = "player_not_found"
        elif owner[player] is not None:
            out[seq] = "player_already_claimed"
        elif blocked is not None and blocked > now:
            out[seq] = "temporarily_blocked"
        elif not players[player]["has_code"]:
            out[seq] = "code_not_configured"
        elif not well_formed:
            out[seq] = "invalid_code_format"
        elif right:
            out[seq] = "ok"
            owner[player] = device
            state.pop(device, None)
        else:
            out[seq], state[device] = count_wrong(n, started, now)
    return out

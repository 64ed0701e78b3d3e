"""Players added, reset and taken out, and claims as of their moment, against a replay row by row."""

import random

import pytest
from pyspark.sql import functions as F

import model
from quorumbook.operators.resets import player_periods, players_now, resolve_claims_over_time

LOG = "seq bigint, changed_at timestamp, op string, code string, display_name string, new_id bigint"
PLAYERS = "id bigint, display_name string, is_active boolean, claimed_user_id bigint, has_code boolean"
ATTEMPTS = "device_id bigint, seq bigint, at bigint, player_id bigint, format_ok boolean, code_ok boolean"


def replayed(players, rows):
    """Outcome of every attempt and the players in the end; rows are attempts and organiser's changes by seq."""
    players = {i: dict(p, resets=0, code=None) for i, p in players.items()}
    names = {p["name"]: i for i, p in players.items()}
    state, out = {}, {}
    for seq, row in sorted(rows):
        if "op" in row:
            i = names.get(row["name"])
            if row["op"] == "insert" and i is None and row["new_id"] is not None:
                names[row["name"]] = row["new_id"]
                players[row["new_id"]] = dict(name=row["name"], active=True, owner=None, has_code=True, resets=0,
                                              code=row["code"])
            elif row["op"] == "reset" and i is not None:
                players[i].update(owner=None, has_code=True, code=row["code"], resets=players[i]["resets"] + 1)
            elif row["op"] == "deactivate" and i is not None:
                players[i]["active"] = False
            continue
        device, p, now = row["device"], players.get(row["player"]), seq * 20_000_000
        mine = [i for i, q in players.items() if q["owner"] == device and q["active"]]
        n, started, blocked = state.get(device, (0, None, None))
        if mine:
            out[seq] = "already_bound_here" if row["player"] in mine else "device_already_bound"
        elif p is None or not p["active"]:
            out[seq] = "player_not_found"
        elif p["owner"] is not None:
            out[seq] = "player_already_claimed"
        elif blocked is not None and blocked > now:
            out[seq] = "temporarily_blocked"
        elif not p["has_code"]:
            out[seq] = "code_not_configured"
        elif not row["format_ok"]:
            out[seq] = "invalid_code_format"
        elif row["code_ok"]:
            out[seq], p["owner"] = "ok", device
            state.pop(device, None)
        else:
            out[seq], state[device] = model.count_wrong(n, started, now)
    return out, players


def log_of(seed, devices=9):
    rng = random.Random(seed)
    players = {i: dict(name=f"P{i}", active=i != 5, owner={3: 100, 4: 101}.get(i), has_code=i != 6) for i in range(8)}
    rows = []
    for seq in range(400):
        if rng.random() < 0.12:
            op = rng.choice(["reset", "reset", "reset", "insert", "deactivate"] if seq > 100 else ["reset", "insert"])
            i = rng.randrange(14)
            rows.append((seq, dict(op=op, name=f"P{i}", new_id=i if op == "insert" else None,
                                   code=None if op == "deactivate" else f"{seq % 100:02}")))
        else:
            rows.append((seq, dict(device=rng.choice([*range(devices), 100, 101, 0, 0, 0]), player=rng.randrange(15),
                                   format_ok=rng.random() > 0.1, code_ok=rng.random() < 0.15)))
    return players, rows


def frames_of(spark, players, rows):
    people = spark.createDataFrame([(i, p["name"], p["active"], p["owner"], p["has_code"]) for i, p in players.items()], PLAYERS)
    log = spark.createDataFrame([(s, model.at(s), r["op"], r["code"], r["name"], r["new_id"]) for s, r in rows if "op" in r], LOG)
    attempts = spark.createDataFrame([(r["device"], s, s * 20_000_000, r["player"], r["format_ok"], r["code_ok"])
                                      for s, r in rows if "op" not in r], ATTEMPTS).withColumn("ts", F.timestamp_micros("at"))
    return people, log, attempts


@pytest.mark.parametrize("seed, heavy", [(1, ()), (2, (0, 100))])
def test_claims_and_players_equal_the_replay(spark, seed, heavy):
    players, rows = log_of(seed)
    people, log, attempts = frames_of(spark, players, rows)
    outcomes, final = replayed(players, rows)
    assert len(set(outcomes.values())) >= 9  # nearly every kind of outcome
    got = {r.seq: r.outcome for r in resolve_claims_over_time(attempts, people, log, heavy).collect()}
    assert got == outcomes
    now = {r.id: r for r in players_now(player_periods(people, log)).collect()}
    assert {i: (r.display_name, r.is_active, r.has_code, r.code, r.resets) for i, r in now.items()} == {
        i: (p["name"], p["active"], p["has_code"], p["code"], p["resets"]) for i, p in final.items()}
    assert now[3].claimed_user_id == (None if final[3]["resets"] else 100)


def test_periods_join_without_gap_or_overlap(spark):
    players, rows = log_of(3)
    people, log, _ = frames_of(spark, players, rows)
    periods = sorted((r.player_id, r.since, r.until) for r in player_periods(people, log).collect())
    for (player, _, until), (other, since, _) in zip(periods, periods[1:]):
        assert until == since if player == other else until == 2**63 - 1


def test_empty_log_and_no_attempts(spark):
    players, rows = log_of(4)
    people, log, attempts = frames_of(spark, players, rows)
    assert players_now(player_periods(people, log.where("false"))).count() == len(players)
    assert resolve_claims_over_time(attempts.where("false"), people, log).collect() == []


def test_rounds_send_nothing_through_the_driver(spark):
    players, rows = log_of(5)
    people, log, attempts = frames_of(spark, players, rows)
    plan = resolve_claims_over_time(attempts, people, log, ())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

"""Sessions against a plain loop, with small parts, few sure cuts and odd rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import sessions as ses

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, session_id long, part int, us long"
BASE = datetime(2024, 3, 10, 1, 30)  # a night in which some zones skip an hour
US = timedelta(microseconds=1)


def plain_version(rows, rules=ses.Rules()):
    us = lambda t: (t - datetime(1970, 1, 1)) // US
    once = {}
    for click, ts, arrived, client, kind, value, *_ in rows:
        if None in (click, ts, client):
            continue
        late = arrived is not None and us(arrived) - us(ts) > rules.late_us
        cents = math.floor(100 * value + 0.5) if value is not None and abs(value) <= 9e13 else 0
        final = value is not None and value >= rules.final_value and kind == rules.final_kind
        c = (us(ts), client, late, cents, final)
        once[click] = min(once.get(click, c), c)
    by_client = defaultdict(list)
    for click, (t, client, late, cents, final) in once.items():
        by_client[client].append((t, click, late, cents, final))
    out = []
    for client, all_ in by_client.items():
        found = []
        for t, click, late, cents, final in sorted(all_):
            if late:
                continue
            why = None
            if found:
                s = found[-1]
                why = "end" if s["final"] else "gap" if t - s["end"] >= rules.gap_us else "length" if t - s["start"] > rules.length_us else None
                if why:
                    s["why"] = why
            if not found or why:
                found.append({"id": click, "start": t, "path": [], "cents": 0, "late": 0, "why": None})
            s = found[-1]
            s["end"], s["final"] = t, final
            s["path"].append(click)
            s["cents"] += cents
        for i, s in enumerate(found):
            until = found[i + 1]["start"] if i + 1 < len(found) else math.inf
            n_late = sum(late and s["start"] <= t < until for t, _, late, *_ in all_)
            why = s["why"] or ("end" if s["final"] else "none")
            out.append((client, s["id"], s["start"], s["end"], len(s["path"]), n_late, s["cents"], why, hashlib.sha256(",".join(map(str, s["path"])).encode()).hexdigest()))
    return Counter(out)


def made(seed, n, clients, step, final=0.1, late=0.05):
    """Clicks of a few clients (the first with most of them) at steps of up to ``step`` seconds."""
    r = np.random.default_rng(seed)
    at, rows = defaultdict(float), []
    for click in r.permutation(n).tolist():
        client = int(r.integers(0, clients)) if r.random() < 0.6 else 0
        at[client] += float(r.integers(0, step + 1)) if r.random() < 0.8 else 0.0
        ts = BASE + timedelta(seconds=at[client])
        arrived = ts + timedelta(minutes=400 if r.random() < late else 360) if r.random() < 0.9 else None
        kind = "error" if r.random() < 2 * final else [None, "view"][int(r.integers(0, 2))]
        rows.append((click, ts, arrived, client, kind, [None, 60.0, 59.99, -3.005, math.nan][int(r.integers(0, 5))] if kind != "error" else float(r.choice([60.0, 12.5])), "{}", 5, 6, 7))
    for i in r.integers(0, n, 9).tolist():
        rows.append(rows[i])
    again = list(rows[3])
    again[1] = again[1] - timedelta(seconds=1)
    return [*rows, tuple(again), (None, *rows[0][1:]), (n + 1, None, *rows[0][2:]), (n + 2, BASE, BASE, None, *rows[0][4:]), (n + 3, BASE, BASE + timedelta(days=1), 77, "error", 99.0, None, 1, 1, 1)]


def found(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,clients,step,final,per_part", [(1, 6, 300, 0.1, 40), (2, 1, 200, 0.0, 25), (3, 3, 700, 0.1, 9), (4, 2, 0, 0.0, 60), (5, 30, 300, 0.05, 7)])
def test_by_a_plain_loop(spark, monkeypatch, seed, clients, step, final, per_part):
    monkeypatch.setattr(ses, "PATH_IDS", 3)
    rows = made(seed, 400, clients, step, final)
    got = ses.sessions(spark.createDataFrame(rows, SCHEMA), rows_per_part=per_part)
    assert found(got) == plain_version(rows)


def test_parts_without_a_sure_cut_wait_for_each_other(spark):
    """One client, a click each minute: only the length cuts, and every part is out of step."""
    rows = [(i, BASE + timedelta(seconds=60 * i), None, 1, "view", 1.0, None, 0, 0, 0) for i in range(300)]
    assert found(ses.sessions(spark.createDataFrame(rows, SCHEMA), rows_per_part=60)) == plain_version(rows)


def test_late_parts_pass_states_on(spark):
    """Hundreds of late clicks between the clicks of one session, so that parts hold no timely one."""
    rows = [(0, BASE, BASE, 1, "view", 1.0, None, 0, 0, 0), (900, BASE + timedelta(seconds=400), BASE, 1, "error", 75.0, None, 0, 0, 0), (901, BASE + timedelta(seconds=400), BASE, 1, None, None, None, 0, 0, 0)]
    rows += [(i, BASE + timedelta(seconds=i), BASE + timedelta(days=2), 1, "view", 1.0, None, 0, 0, 0) for i in range(1, 300)]
    rows += [(950, BASE + timedelta(seconds=400), BASE + timedelta(days=2), 1, "view", 1.0, None, 0, 0, 0)]
    got = ses.sessions(spark.createDataFrame(rows, SCHEMA), rows_per_part=20)
    assert found(got) == plain_version(rows) and {r.n_late for r in got.collect()} == {299, 1}


def test_other_rules_zones_and_empty_tables(spark):
    rows = made(9, 200, 4, 90)
    rules = ses.Rules(gap_us=60 * 10**6, length_us=5 * ses.MINUTE, late_us=390 * ses.MINUTE, final_kind="view", final_value=0.0)
    d = spark.createDataFrame(rows, SCHEMA)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert found(ses.sessions(d, rules, rows_per_part=30)) == plain_version(rows, rules)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found(ses.sessions(d.withColumn("ts", d["ts"].cast("timestamp")).withColumn("arrived_at", d["arrived_at"].cast("timestamp")), rules)) == plain_version(rows, rules)
    assert ses.sessions(d.limit(0)).count() == 0


def test_soft_cuts_fall_in_step():
    """A head scanned with an entry and without one ends in the same state once both cut at the same click."""
    u = [0, 30, 60, 90, 120, 150]
    t = pa.table({"kind": ["head"] * 6, "client_id": [1] * 6, "session_id": list(range(6)), "start_us": [x * ses.MINUTE for x in u], "n_late": [0] * 6, "value_cents": [0] * 6, "final": [False] * 6, "closed_by": pa.array([None] * 6, pa.string())})
    rules = ses.Rules(gap_us=10**15, length_us=40 * ses.MINUTE)
    _, fresh = ses.resume(1, t, None, rules)
    _, in_step = ses.resume(1, t, ses.State(1, 99, -50 * ses.MINUTE, -5 * ses.MINUTE, False), rules)
    _, off = ses.resume(1, t, ses.State(1, 99, -20 * ses.MINUTE, -5 * ses.MINUTE, False), rules)
    assert fresh == in_step and fresh.session == 4 and off.session == 5

"""Gap sessionisation by a speculative parallel scan.

Clicks are range-partitioned and sorted by client and time; each part is scanned as if a session began at its first click.
A cut by ``end`` or ``gap`` hangs on two neighbouring clicks only, so everything from a part's first such cut on (or its
first change of client) is settled at once. What comes before it, the part's *head*, hangs on the session that is open
where the part begins. The parts' exit states are exchanged by a join of each part with the one before it; a part whose
entry differs from the one it was scanned with is scanned again over its head, and hands its new exit state on, until no
entry changes. Only a part without a sure cut can change its exit, and only if its cuts by ``length`` don't fall in step.

At the end, heads are cut with their true entries, and the fragments of a session that several parts share are put
together. Nothing is collected or broadcast: states, heads and fragments are tables that meet by sort-merge joins; the driver sees the number of rows and whether a
round had work. A part holds about ``rows_per_part`` clicks whatever their client, since click ids tell equal times apart.
The path of one session is hashed in order as a stream, in one task if parts share it, in pieces of bounded size.

Defined cases: clicks without click_id, client_id or ts are left out; of rows with an equal click_id the least (ts,
client_id, late, cents, final) counts; a null arrived_at is not late; a null kind, or a value that is null or NaN, is not final; a value that is null, not
finite or beyond 9e13 counts 0 cents; late clicks before a client's first session, or of a client without timely clicks,
count nowhere; equal times go by click_id; kind and props of any length don't matter; other columns are ignored; an empty
table has no sessions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from . import shared as S

#: Click ids of a path that a row may hold.
PATH_IDS = 1 << 16
MINUTE = 60_000_000
ORDER = ["client_id", "us", "late", "click_id"]
STATE = "client long, session long, first_us long, prev_us long, final boolean"
FRAGMENT = "kind string, part int, seq int, client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, final boolean, closed_by string, path string"
#: One row type for what a scan gives: ``done`` sessions, ``part`` fragments, single clicks of heads (``head``, and ``stop`` for the sure cut after them) and the exit ``state``.
SCAN = FRAGMENT + ", first_client long, certain boolean"
SESSION = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string"


@dataclass(frozen=True)
class Rules:
    gap_us: int = 10 * MINUTE
    length_us: int = 40 * MINUTE
    late_us: int = 360 * MINUTE
    final_kind: str = "error"
    final_value: float = 60.0


@dataclass
class State:
    """The open session after some clicks, and its last click."""

    client: int
    session: int
    first_us: int
    prev_us: int
    final: bool

    def met(self, us: int, rules: Rules) -> str | None:
        """Why the client's next click at ``us`` doesn't continue the session."""
        if self.final:
            return "end"
        if us - self.prev_us >= rules.gap_us:
            return "gap"
        return "length" if us - self.first_us > rules.length_us else None


# --- clicks -------------------------------------------------------------------------
def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, whatever the session's zone."""
    c = F.col(name)
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (days * 24 + F.hour(c)) * 60 + F.minute(c)
    return minutes * MINUTE + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def timely(clicks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """client_id, us, late, click_id, cents, final: each click_id once."""
    us, v = micros(clicks, "ts"), F.col("value").cast("double")
    cents = F.when(F.abs(v) <= 9e13, F.floor(v * 100 + 0.5)).otherwise(0)  # NaN is greater than any number
    rows = clicks.where("click_id is not null and client_id is not null and ts is not null").select(
        F.col("click_id").cast("long").alias("click_id"),
        F.struct(
            us.alias("us"),
            F.col("client_id").cast("long").alias("client_id"),
            F.coalesce(micros(clicks, "arrived_at") - us > rules.late_us, F.lit(False)).alias("late"),
            F.coalesce(cents, F.lit(0)).cast("long").alias("cents"),
            F.coalesce((v >= rules.final_value) & ~F.isnan(v) & (F.col("kind") == rules.final_kind), F.lit(False)).alias("final"),
        ).alias("c"),
    )
    return rows.groupBy("click_id").agg(F.min("c").alias("c")).select("c.client_id", "c.us", "c.late", "click_id", "c.cents", "c.final")


# --- a part -------------------------------------------------------------------------
class Rows:
    """Columns of scan rows, put together row by row or array by array."""

    def __init__(self):
        self.out: list[dict] = []

    def add(self, kind: str, n: int = 1, **cols) -> None:
        self.out.append({"kind": [kind] * n, **{k: v if isinstance(v, (list, np.ndarray)) else [v] * n for k, v in cols.items()}})

    def fragment(self, part: int, state: State, ids: list[str], n_late: int, cents: int, last: tuple[int, bool] | None, closed_by: str | None) -> None:
        """A fragment's counts in its first row; more rows carry what doesn't fit of its path."""
        for seq, lo in enumerate(range(0, max(len(ids), 1), PATH_IDS)):
            own = seq == 0
            self.add(
                "part", part=part, seq=seq, client_id=state.client, session_id=state.session, start_us=state.first_us, end_us=last[0] if last else None, n_clicks=len(ids) if own else 0,
                n_late=n_late if own else 0, value_cents=cents if own else 0, final=last[1] if last else None, closed_by=closed_by, path=",".join(ids[lo : lo + PATH_IDS]),
            )

    def state(self, part: int, first_client: int | None, certain: bool, s: State | None) -> None:
        self.add("state", part=part, client_id=s and s.client, session_id=s and s.session, start_us=s and s.first_us, end_us=s and s.prev_us, final=s and s.final, first_client=first_client, certain=certain)

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for cols in self.out:
            n = len(cols["kind"])
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def _long_cuts(us: np.ndarray, first: int, length: int) -> list[int]:
    """Where sessions begin among clicks of one run without a gap or end, when one has begun at ``first`` microseconds."""
    cuts, at = [], int(np.searchsorted(us, first + length, side="right"))
    while at < len(us):
        cuts.append(at)
        at = int(np.searchsorted(us, us[at] + length, side="right"))
    return cuts


def _per_session(late_at: np.ndarray, times: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the last session that began before each late click by position; -1 if none."""
    return np.searchsorted(starts, np.searchsorted(times, late_at) - 1, side="right") - 1


def speculate(part: int, t: pa.Table, rules: Rules) -> Rows:
    """Scan a part as if a session began at its first click: settled sessions, head, open fragment and exit state."""
    out = Rows()
    if not t.num_rows:
        out.state(part, None, False, None)
        return out
    client, us, click, cents = (t[c].to_numpy() for c in ("client_id", "us", "click_id", "cents"))
    late, final = t["late"].to_numpy(zero_copy_only=False), t["final"].to_numpy(zero_copy_only=False)
    first_client, at = int(client[0]), np.flatnonzero(~late)
    c, u, f = client[at], us[at], final[at]
    other = np.ones(len(at), bool)
    other[1:] = c[1:] != c[:-1]
    end, gap = np.zeros(len(at), bool), np.zeros(len(at), bool)
    end[1:] = f[:-1] & ~other[1:]
    gap[1:] = (u[1:] - u[:-1] >= rules.gap_us) & ~other[1:]
    sure = other | end | gap
    if len(at):
        sure[0] = c[0] != first_client
    first = int(np.argmax(sure)) if sure.any() else len(at)

    # head: the first client's clicks before the first sure cut, and that cut
    edge = int(at[first]) if first < len(at) else t.num_rows
    head = np.flatnonzero(client[:edge] == first_client)
    if len(head):
        out.add("head", len(head), part=part, client_id=client[head], session_id=click[head], start_us=us[head], n_late=late[head].astype(np.int64), value_cents=cents[head], final=final[head])
    if first < len(at) and c[first] == first_client:
        out.add("stop", part=part, client_id=first_client, session_id=int(click[at[first]]), start_us=int(u[first]), n_late=0, closed_by="end" if end[first] else "gap")
    if first == len(at):
        clicks = [(int(u[i]), int(click[at[i]]), bool(f[i])) for i in range(len(at))]
        cuts = [0, *(k for k in _long_cuts(u, int(u[0]), rules.length_us))] if len(at) else []
        s = State(first_client, clicks[cuts[-1]][1], clicks[cuts[-1]][0], clicks[-1][0], clicks[-1][2]) if cuts else None
        out.state(part, first_client, False, s)
        return out

    # sessions after the first sure cut
    runs = np.append(np.flatnonzero(sure[first:]) + first, len(at))
    starts = list(runs[:-1])
    for i in np.flatnonzero(u[runs[1:] - 1] - u[runs[:-1]] > rules.length_us):
        lo, hi = runs[i], runs[i + 1]
        starts += [lo + k for k in _long_cuts(u[lo:hi], int(u[lo]), rules.length_us)]
    starts = np.sort(np.array(starts, dtype=np.int64))
    stops = np.append(starts[1:], len(at))
    late_at = np.flatnonzero(late)
    own = _per_session(late_at, at, starts)
    ok = own >= 0
    ok[ok] = client[late_at[ok]] == c[starts[own[ok]]]
    n_late = np.bincount(own[ok], minlength=len(starts))
    total = np.add.reduceat(cents[at], starts)
    ids = click[at].astype(str).tolist()
    n = len(starts) - 1  # the last one stays open
    if n:
        nxt = starts[1:]
        why = np.where(end[nxt], "end", np.where(gap[nxt], "gap", "length")).astype(object)
        gone = other[nxt]
        why[gone] = np.where(f[stops[:-1][gone] - 1], "end", "none")
        paths = [hashlib.sha256(",".join(ids[a:b]).encode()).hexdigest() for a, b in zip(starts[:-1].tolist(), nxt.tolist())]
        a = starts[:-1]
        out.add("done", n, part=part, client_id=c[a], session_id=click[at[a]], start_us=u[a], end_us=u[nxt - 1], n_clicks=nxt - a, n_late=n_late[:-1], value_cents=total[:-1], closed_by=why.tolist(), path=paths)
    a = int(starts[-1])
    s = State(int(c[a]), int(click[at[a]]), int(u[a]), int(u[-1]), bool(f[-1]))
    out.fragment(part, s, ids[a:], int(n_late[-1]), int(total[-1]), (s.prev_us, s.final), None)
    out.state(part, first_client, True, s)
    return out


def resume(part: int, t: pa.Table, entry: State | None, rules: Rules) -> tuple[Rows, State | None]:
    """Cut a head that begins with the open session ``entry``: its fragments, and the state after it."""
    out = Rows()
    stop = t["closed_by"][-1].as_py() if t["kind"][-1].as_py() == "stop" else None
    if stop:
        t = t[:-1]
    late = t["n_late"].to_numpy() > 0
    at = np.flatnonzero(~late)
    u, ids, cents, f = (t[c].to_numpy(zero_copy_only=False)[at] for c in ("start_us", "session_id", "value_cents", "final"))
    if not len(at) and entry is None:
        return out, None
    client = int(t["client_id"][0].as_py()) if t.num_rows else entry.client
    why = entry.met(int(u[0]), rules) if entry and len(at) else None
    fresh = len(at) and (entry is None or why is not None)
    cuts = ([0] if fresh else []) + (_long_cuts(u, int(u[0]) if fresh else entry.first_us, rules.length_us) if len(at) else [])
    starts = np.array(cuts, dtype=np.int64)
    own = _per_session(np.flatnonzero(late), at, starts)
    n_late = np.bincount(own + 1, minlength=len(cuts) + 1)  # place 0 is the entry's session
    edges, words = [*cuts, len(at)], ids.astype(str).tolist()
    state = entry
    if entry:
        b = edges[0]
        last = (int(u[b - 1]), bool(f[b - 1])) if b else None
        closed = (why or "length") if cuts else stop
        out.fragment(part, entry, words[:b], int(n_late[0]), int(cents[:b].sum()), last, closed)
        if last:
            state = State(entry.client, entry.session, entry.first_us, *last)
    for i, a in enumerate(cuts):
        b = edges[i + 1]
        state = State(client, int(ids[a]), int(u[a]), int(u[b - 1]), bool(f[b - 1]))
        out.fragment(part, state, words[a:b], int(n_late[i + 1]), int(cents[a:b].sum()), (state.prev_us, state.final), "length" if i + 1 < len(cuts) else stop)
    return out, state


# --- all parts ------------------------------------------------------------------------
def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _resumed(heads: DataFrame, entries: DataFrame, tasks: int, rules: Rules) -> DataFrame:
    """Scan the heads of parts anew with their entries (part, entry); a part's rows meet in one task, a part at a time."""
    schema = _arrow(SCAN)

    def run(batches):
        for t, edges in S.whole_groups(batches, ["part"]):
            for lo, hi in zip(edges[:-1], edges[1:]):
                g = t[int(lo) : int(hi)]
                e, part = g["entry"][0].as_py(), g["part"][0].as_py()
                rows, state = resume(part, g, State(**e) if e else None, rules)
                rows.state(part, None, False, state)
                yield from rows.batches(schema)

    met = heads.join(entries.hint("merge"), "part").select("kind", "part", "client_id", "session_id", "start_us", "n_late", "value_cents", "final", "closed_by", "entry")
    return met.repartition(tasks, "part").sortWithinPartitions("part", "start_us", "n_late", "session_id").mapInArrow(run, SCAN)


def _joined(fragments: DataFrame, tasks: int) -> DataFrame:
    """Sessions of fragments; a session's rows come in order and its path is hashed as they come."""
    schema = _arrow(SESSION)

    def run(batches):
        own = None
        rows: list[dict] = []

        def closed(x):
            x["path_sha256"] = x.pop("sha").hexdigest()
            x["closed_by"] = x["closed_by"] or ("end" if x["final"] else "none")
            del x["final"], x["bare"]
            return x

        for batch in batches:
            for r in batch.to_pylist():
                if own is None or (own["client_id"], own["session_id"]) != (r["client_id"], r["session_id"]):
                    if own is not None:
                        rows.append(closed(own))
                    own = {"client_id": r["client_id"], "session_id": r["session_id"], "start_us": r["start_us"], "end_us": r["start_us"], "n_clicks": 0, "n_late": 0, "value_cents": 0, "closed_by": None, "final": False, "sha": hashlib.sha256(), "bare": True}
                for k in ("n_clicks", "n_late", "value_cents"):
                    own[k] += r[k]
                if r["path"]:
                    own["sha"].update(("" if own["bare"] else ",").encode() + r["path"].encode())
                    own["bare"] = False
                if r["end_us"] is not None:
                    own["end_us"], own["final"] = r["end_us"], r["final"]
                own["closed_by"] = own["closed_by"] or r["closed_by"]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([closed(own)], schema=schema)

    return fragments.repartition(tasks, "client_id", "session_id").sortWithinPartitions("client_id", "session_id", "part", "seq").mapInArrow(run, SESSION)


def sessions(clicks: DataFrame, rules: Rules = Rules(), rows_per_part: int = 200_000) -> DataFrame:
    """client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by and path_sha256 of every session."""
    spark = clicks.sparkSession
    parts = max(1, -(-clicks.count() // rows_per_part))
    tasks = max(1, parts // 4)  # heads and fragments are a small part of their parts
    schema = _arrow(SCAN)

    def scan(batches):
        got = [b for b in batches if b.num_rows]
        t = pa.Table.from_batches(got).combine_chunks() if got else pa.table({c: [] for c in ORDER})
        yield from speculate(TaskContext.get().partitionId(), t, rules).batches(schema)

    S.ship(spark)
    ordered = timely(clicks, rules).repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    cut = S.materialize(ordered.mapInArrow(scan, SCAN), "cut")
    heads = cut.where("kind in ('head', 'stop')")

    none = F.lit(None).cast(f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>")
    state = F.when(F.col("client_id").isNotNull(), F.struct(F.col("client_id").alias("client"), F.col("session_id").alias("session"), F.col("start_us").alias("first_us"), F.col("end_us").alias("prev_us"), "final"))
    states = S.materialize(cut.where("kind = 'state'").select("part", "first_client", "certain", state.alias("exit"), none.alias("used")), "states")

    def entered() -> DataFrame:
        """states and what each part is entered with: the exit before it, if that is of its first client or the part is empty."""
        before = states.select((F.col("part") + 1).alias("part"), F.col("exit").alias("_e"))
        fits = F.col("first_client").isNull() | (F.col("first_client") == F.col("_e.client"))
        return states.join(before.hint("merge"), "part", "left").withColumn("entry", F.when(fits, F.col("_e"))).drop("_e")

    while True:
        todo = S.materialize(entered().where(~F.col("certain") & ~F.col("entry").eqNullSafe(F.col("used"))).select("part", "first_client", "entry"), "todo")
        if todo.isEmpty():
            S.drop_table(todo)
            break
        again = _resumed(heads, todo.select("part", "entry"), tasks, rules).where("kind = 'state'").select("part", state.alias("_x"))
        empty = todo.where("first_client is null").select("part", F.col("entry").alias("_x"))
        new = todo.select("part", "entry", F.lit(True).alias("_hit")).join(again.unionByName(empty).hint("merge"), "part", "left")
        both = states.join(new.hint("merge"), "part", "left")
        moved = both.select("part", "first_client", "certain", F.when(F.col("_hit"), F.col("_x")).otherwise(F.col("exit")).alias("exit"), F.when(F.col("_hit"), F.col("entry")).otherwise(F.col("used")).alias("used"))
        moved = S.materialize(moved, "states")
        S.drop_table(states)
        S.drop_table(todo)
        states = moved

    fragments = _resumed(heads, entered().select("part", "entry"), tasks, rules).where("kind = 'part'").unionByName(cut.where("kind = 'part'"))
    done = cut.where("kind = 'done'").withColumn("path_sha256", F.col("path"))
    columns = [c.split()[0] for c in SESSION.split(", ")]
    return done.select(columns).unionByName(_joined(fragments.select([c.split()[0] for c in FRAGMENT.split(", ")]), tasks))


def op12(spark, sf_dir: str) -> DataFrame:
    return sessions(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


OP12_SQL = """
WITH RECURSIVE a AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 21600000000, false) AS late,
    coalesce(value >= 60 AND NOT isnan(value) AND kind = 'error', false) AS final, CASE WHEN abs(value) <= 9e13 THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY us, client_id, late, cents, final) AS k FROM a) WHERE k = 1),
w AS (SELECT *, row_number() OVER (ORDER BY client_id, us, click_id) AS rn, lag(us) OVER p AS pus, lag(final) OVER p AS pfinal FROM c WHERE NOT late WINDOW p AS (PARTITION BY client_id ORDER BY us, click_id)),
h AS (SELECT *, CASE WHEN pus IS NULL THEN 'first' WHEN pfinal THEN 'end' WHEN us - pus >= 600000000 THEN 'gap' END AS hard FROM w),
t AS (SELECT *, count(hard) OVER (ORDER BY rn) AS seg FROM h),
n AS MATERIALIZED (SELECT rn, min(rn) OVER (PARTITION BY seg ORDER BY us RANGE BETWEEN 2400000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t),
s AS (SELECT rn FROM t WHERE hard IS NOT NULL UNION ALL SELECT n.nxt FROM s JOIN n ON s.rn = n.rn WHERE n.nxt IS NOT NULL),
x AS (SELECT t.*, max(s.rn) OVER (ORDER BY t.rn) AS own FROM t LEFT JOIN s ON s.rn = t.rn),
g AS (SELECT own, client_id, arg_min(click_id, rn) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents, arg_max(final, rn) AS last_final,
  arg_min(hard, rn) AS began, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY rn)) AS path_sha256, bool_or(hard IS NOT NULL) AS is_hard FROM x GROUP BY own, client_id),
l AS (SELECT b.own, count(*) AS n_late FROM c ASOF JOIN (SELECT client_id, start_us, max(own) AS own FROM g GROUP BY ALL) b ON c.client_id = b.client_id AND c.us >= b.start_us WHERE c.late GROUP BY b.own),
e AS (SELECT *, lead(own) OVER q IS NOT NULL AS more, lead(CASE WHEN is_hard THEN began ELSE 'length' END) OVER q AS reason FROM g WINDOW q AS (PARTITION BY client_id ORDER BY own))
SELECT client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents, CASE WHEN more THEN reason WHEN last_final THEN 'end' ELSE 'none' END AS closed_by, path_sha256
FROM e LEFT JOIN l USING (own)
"""

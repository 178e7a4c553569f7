"""Rounds in which every node takes the label most frequent among its neighbours, on packed parts of numbered nodes.

Node k of n is number k // parts of part k % parts.  A part's labels are one packed value, and so are its links to another part; a
round sends the labels along the links and counts them where they arrive, so what is shuffled are packed values and no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written

#: Links of a part.  A part with ``MANY`` times as many is dealt into chunks, and targets with more are counted by rows.
LINKS, MANY = 1 << 20, 4
SENT, STATE = "q long, t binary, label binary", "p long, label binary, before binary, moved boolean, again boolean"


def _table(schema: dict, rows: list) -> pa.Table:
    return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(schema.items())})


def _column(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for c in t[name].chunks for x in c if x.is_valid)])


def _runs(v: np.ndarray) -> np.ndarray:
    """Where each run of equals begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(v)), bool), v[1:] != v[:-1]]))


def _split(number: np.ndarray, *columns: np.ndarray):
    """Each number with its rows of the columns, in their order."""
    small = len(number) and -(1 << 15) <= number.min() and number.max() < 1 << 15
    order = np.argsort(number.astype(np.int16) if small else number, kind="stable")  # short numbers are sorted by their digits
    for o in np.split(order, _runs(number[order])[1:]) if len(order) else ():
        yield (int(number[o[0]]), *(c[o] for c in columns))


def _packed(parts: int, chunks: dict[int, int]):
    """Links (a, b) by the part of a and a chunk of it, packed."""
    many = np.ones(parts, np.int64)
    for p, c in chunks.items():
        many[p] = c
    most = int(many.max())

    def pack(a, b):
        p = a % parts
        rows = [(x // most, x % most, y.tobytes(), z.tobytes()) for x, y, z in _split(p * most + b // parts % many[p], a, b)]
        return _table({"p": pa.int64(), "c": pa.int64(), "a": pa.binary(), "b": pa.binary()}, rows).to_batches()

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= LINKS:
                yield from pack(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            yield from pack(*map(np.concatenate, zip(*held)))

    return run


def _arranged(parts: int, hubs: np.ndarray):
    """A chunk's links by the part of their targets, in the order of targets; those to hub i under -1 - i."""

    def work(rows: pa.Table) -> pa.Table:
        p, c, a, b = rows["p"][0].as_py(), rows["c"][0].as_py(), _column(rows, "a", np.int64), _column(rows, "b", np.int64)
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        hub = np.minimum(np.searchsorted(hubs, b), max(0, len(hubs) - 1))
        q = np.where(hubs[hub] == b, -1 - hub, b % parts) if len(hubs) else b % parts
        out = [(p, c, x, (y // parts).astype(np.uint32).tobytes(), (z // parts).astype(np.uint32).tobytes()) for x, y, z in _split(q, a, b)]
        return _table({"p": pa.int64(), "c": pa.int64(), "q": pa.int64(), "s": pa.binary(), "t": pa.binary()}, out)

    return work


def _sent(links: pa.Table, own: pa.Table) -> pa.Table:
    """The labels of a part along its links; for a hub each label once, with its count in place of a target."""
    out = []
    if links.num_rows:
        label = _column(own, "label", np.int64)
        for i, q in enumerate(links["q"].to_pylist()):
            told = label[_column(links[i : i + 1], "s", np.uint32)]
            if q >= 0:
                out.append((q, links["t"][i].as_py(), told.tobytes()))
            else:
                told, n = np.unique(told, return_counts=True)
                out.append((q, n.astype(np.int64).tobytes(), told.tobytes()))
    return _table({"q": pa.int64(), "t": pa.binary(), "label": pa.binary()}, out)


def _counted(batches):
    """Rows of hub, community and n."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        for i, q in enumerate(t["q"].to_pylist()):
            n = _column(t[i : i + 1], "t", np.int64)
            yield from pa.table({"q": np.full(len(n), q), "community": _column(t[i : i + 1], "label", np.int64), "n": n}).to_batches()


def _voted(n: int, parts: int, best: dict[int, int]):
    """Labels of a part after a round, and whether they differ from those one and two rounds before."""

    def work(sent: pa.Table, own: pa.Table) -> pa.Table:
        p, label, before = own["p"][0].as_py(), _column(own, "label", np.int64), _column(own, "before", np.int64)
        vote = _column(sent, "t", np.uint32).astype(np.int64) * n + _column(sent, "label", np.int64)
        vote.sort()
        run = _runs(vote)
        count, target, told = np.diff(np.append(run, len(vote))), vote[run] // n, vote[run] % n
        new = label.copy()
        if len(run):
            begin = _runs(target)
            most = np.repeat(np.maximum.reduceat(count, begin), np.diff(np.append(begin, len(run))))
            first = np.flatnonzero(count == most)
            first = first[_runs(target[first])]  # the least label of equals
            new[target[first]] = told[first]
        for key, community in best.items():
            if key % parts == p:
                new[key // parts] = community
        row = (p, new.tobytes(), label.tobytes(), bool((new != label).any()), not len(before) == len(new) or bool((new != before).any()))
        return _table({"p": pa.int64(), "label": pa.binary(), "before": pa.binary(), "moved": pa.bool_(), "again": pa.bool_()}, [row])

    return work


def _first(n: int, parts: int):
    def run(batches):
        for batch in batches:
            rows = [(p, np.arange(p, n, parts, dtype=np.int64).tobytes(), None) for p in batch.column(0).to_pylist()]
            yield from _table({"p": pa.int64(), "label": pa.binary(), "before": pa.binary()}, rows).to_batches()

    return run


def _unpacked(parts: int, column: str):
    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for i, p in enumerate(t["p"].to_pylist()):
                label = _column(t[i : i + 1], column, np.int64)
                yield from pa.table({"key": np.arange(len(label), dtype=np.int64) * parts + p, "community": label}).to_batches()

    return run


def _chunks(chunks: dict[int, int]) -> Column:
    known = F.create_map(*(F.lit(x).cast("long") for pair in ((-1, 1), *chunks.items()) for x in pair))
    return F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.try_element_at(known, F.col("p")), F.lit(1).cast("long")) - 1)).alias("c")


def most_frequent(links: DataFrame, n: int, rounds: int) -> DataFrame:
    """key, community: labels of the nodes 0 to n - 1, which begin with their own numbers, after ``rounds`` over links (a, b).

    A node takes the label that most of its links (by a) tell it, the least of equals; without links it keeps its own.  Labels
    follow from those of the round before, so rounds end early once they equal those one or two rounds before.
    """
    spark = links.sparkSession
    total = links.count()
    parts = max(1, spark.sparkContext.defaultParallelism, -(-total // LINKS))
    size = {r.p: r.n for r in links.groupBy((F.col("a") % parts).alias("p")).agg(F.count("*").alias("n")).where(F.col("n") > MANY * LINKS).collect()}
    chunks, hubs = {p: -(-k // LINKS) for p, k in size.items()}, []
    if size:  # links go both ways, so where a target has many, its part has
        told = links.where((F.col("b") % parts).isin(list(size))).groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > MANY * LINKS)
        hubs = sorted(r.b for r in told.collect())
    packed = links.select("a", "b").mapInArrow(_packed(parts, chunks), "p long, c long, a binary, b binary")
    laid = written(packed.groupBy("p", "c").applyInArrow(_arranged(parts, np.array(hubs, np.int64)), "p long, c long, q long, s binary, t binary"), "links")
    state = spark.range(parts).mapInArrow(_first(n, parts), "p long, label binary, before binary")
    ends = "label"

    def told_by(some: DataFrame) -> DataFrame:
        own = state.select("p", _chunks(chunks), "label")
        return some.groupBy("p", "c").cogroup(own.groupBy("p", "c")).applyInArrow(_sent, SENT)

    for r in range(1, rounds + 1):
        best = {}
        if hubs:
            votes = told_by(laid.where("q < 0")).mapInArrow(_counted, "q long, community long, n long").groupBy("q", "community").agg(F.sum("n").alias("n"))
            best = {hubs[-1 - x.q]: x.c for x in votes.groupBy("q").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("c")).collect()}
        sent = told_by(laid.where("q >= 0"))
        new = written(sent.groupBy("q").cogroup(state.groupBy("p")).applyInArrow(_voted(n, parts, best), STATE))
        dropped(state)
        state = new
        moved, again = state.agg(F.max("moved"), F.max("again")).first()
        if not moved:
            break
        if not again:  # and so on in turns
            ends = "before" if (rounds - r) % 2 else "label"
            break
    dropped(laid)
    return state.mapInArrow(_unpacked(parts, ends), "key long, community long")

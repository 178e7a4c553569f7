"""Iterative graph operators: neighbourhoods, closure, components, labels, PageRank, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..session import dropped
from ..session import written as cut
from .relational import neighbours
from .votes import most_frequent


def k_hop(g: Graph, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """seed, id, hop: nodes within ``hops`` of each seed (column id), without the seed, at their least hop."""
    step = cut(neighbours(g, direction).distinct())
    reached = frontier = seeds.select(F.col("id").alias("seed"), "id").withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        frontier = cut(frontier.join(step, "id").select("seed", F.col("neighbour").alias("id")).distinct().join(reached, ["seed", "id"], "left_anti").withColumn("hop", F.lit(h)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.where("hop > 0")


def closure(edges: DataFrame) -> DataFrame:
    """a, b: all pairs with a path from a to b, to the fix-point.

    A round joins only the pairs found in the round before, first with the steps and then with all pairs so far, which doubles
    the lengths that are known.
    """
    paths = new = cut(edges.select("a", "b").distinct())
    while not new.isEmpty():
        more = new.select("a", F.col("b").alias("m")).join(paths.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        new = cut(more.distinct().join(paths, ["a", "b"], "left_anti"))
        paths = paths.unionAll(new)
    return paths


def components(g: Graph) -> DataFrame:
    """id, component: the least id that a node is connected with, itself included.

    Every round hangs nodes under their least neighbour, follows that to the top and contracts the edges.
    """
    edges = cut(g.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a <> b"))
    label = cut(g.nodes.select("id", F.col("id").alias("component")))
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).select(F.col("a").alias("id"), "p"))
        while True:
            top = up.select(F.col("id").alias("q"), F.col("p").alias("pp"))
            up = cut(up.select("id", "p").join(top, F.col("p") == F.col("q")).select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            if up.where("moved").isEmpty():
                break
        own = up.select(F.col("id").alias("component"), "p")
        label = cut(label.join(own, "component", "left").select("id", F.coalesce("p", "component").alias("component")))
        e = edges.join(up.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        edges = cut(e.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    return label


#: Targets in one row of an adjacency; a hub has as many rows as it needs.
ADJACENT = 1000


def numbered(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, key), keys from 0 on in the order of ids, and edges as keys (a, b; b null where the target doesn't exist), written once so that rounds join numbers and no texts."""
    placed = cut(g.nodes.select("id").orderBy("id").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    size = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first = [(p, sum(n for _, n in size[:i])) for i, (p, _) in enumerate(size)]
    first = g.nodes.sparkSession.createDataFrame(first, "part long, first long")  # one row for each task of the sort
    keys = placed.select("id", part.alias("part"), place.alias("place")).join(F.broadcast(first), "part").select("id", (F.col("first") + F.col("place")).alias("key"))
    e = g.edges.select("from_id", "to_id").join(keys.select(F.col("id").alias("from_id"), F.col("key").alias("a")), "from_id")
    return keys, cut(e.join(keys.select(F.col("id").alias("to_id"), F.col("key").alias("b")), "to_id", "left").select("a", "b"))


def adjacency(edges: DataFrame) -> DataFrame:
    """key, d (edges from it), targets of edges (a, b), in rows of some ``ADJACENT`` targets."""
    e = edges.join(edges.groupBy("a").agg(F.count("*").alias("d")), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / ADJACENT)))
    return cut(e.groupBy("a", "d", "part").agg(F.collect_list("b").alias("targets")).select(F.col("a").alias("key"), "d", "targets"))


def label_propagation(g: Graph, rounds: int = 20) -> DataFrame:
    """id, community: all nodes at once take the label most frequent among their neighbours (least label of equals).

    Rounds go on for ``rounds``, as in the reference, or until labels return: see :func:`votes.most_frequent`.
    """
    keys, edges = numbered(g)
    both = edges.where("a <> b")
    label = most_frequent(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), keys.count(), rounds)
    dropped(edges)
    named = keys.select(F.col("key").alias("community"), F.col("id").alias("name"))
    return label.join(named, "community").join(keys, "key").select("id", F.col("name").alias("community"))


def pagerank(g: Graph, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """id, rank divided by the largest, rounded to 6; what nodes without out-edges hold is shared by all.

    A round gives all nodes the same and moves what they have along the edges, so a rank is a weighted sum of what one unit a node has
    become after 0, 1, 2, ... moves. Only nodes that hold something move it, and the moves end early when nothing is left, as in a graph without cycles.
    """
    keys, edges = numbered(g)
    e = adjacency(edges)
    dropped(edges)
    out = e.select("key").distinct()
    n = keys.count()
    moved, lost = [], [float(n - out.count())]  # of each number of moves: who holds how much, and what nodes without out-edges hold
    held = keys.select("key", F.lit(1.0).alias("x"))
    for k in range(1, rounds + 1):
        got = e.join(held, "key").select(F.explode("targets").alias("key"), (F.col("x") / F.col("d")).alias("x")).where("key is not null")
        held = cut(got.groupBy("key").agg(F.sum("x").alias("x")))
        moved.append(held)
        lost.append(held.join(out, "key", "left_anti").agg(F.sum("x")).first()[0] or 0.0)
        if held.isEmpty():
            break
    lost += [0.0] * (rounds + 1 - len(lost))
    share = []  # what a round gives to all
    for t in range(rounds):
        last = sum(share[t - 1 - k] * damping**k * lost[k] for k in range(t)) + damping**t * lost[t] / max(n, 1)
        share.append(((1 - damping) + damping * last) / max(n, 1))
    weight = [share[rounds - 1 - k] * damping**k for k in range(rounds)] + [damping**rounds / max(n, 1)]
    parts = [h.select("key", (F.lit(w) * F.col("x")).alias("x")) for h, w in zip(moved, weight[1:])]
    rank = keys.select("id", "key", F.lit(weight[0]).alias("r"))
    if parts:
        more = reduce(DataFrame.unionAll, parts).groupBy("key").agg(F.sum("x").alias("x"))
        rank = rank.join(more, "key", "left").select("id", (F.col("r") + F.coalesce("x", F.lit(0.0))).alias("r"))
    rank = cut(rank.select("id", "r"))
    dropped(e)
    for h in moved:
        dropped(h)
    top = rank.agg(F.max("r").alias("m"))
    return rank.crossJoin(F.broadcast(top)).select("id", F.round(F.col("r") / F.col("m"), 6).alias("rank"))  # one row


def lineage(g: Graph, sources: DataFrame, sinks: DataFrame, depth: int, relations: list[str], cap: int = 50) -> DataFrame:
    """source, sink, path, length, confidence: breadth-first paths, one for each node reached (the least path), ``cap`` a source."""
    step = cut(g.edges.where(F.col("relation").isin(*relations)).select(F.col("from_id").alias("id"), F.col("to_id").alias("next")).distinct())
    frontier = sources.select(F.col("id").alias("source"), "id", F.array("id").alias("path"))
    seen, found = frontier.select("source", "id"), []
    for _ in range(depth):
        frontier = frontier.join(step, "id").select("source", F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        frontier = cut(frontier.join(seen, ["source", "id"], "left_anti").groupBy("source", "id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("source", "id"))
        found.append(frontier.join(sinks.select("id"), "id", "left_semi"))
    if not found:
        return frontier.select("source", F.col("id").alias("sink"), F.array_join("path", ">").alias("path"), F.size("path").alias("length"), F.lit("high").alias("confidence"))
    all_ = reduce(DataFrame.unionByName, found).withColumn("length", F.size("path"))
    w = Window.partitionBy("source").orderBy("length", "id")
    top = all_.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    return top.select("source", F.col("id").alias("sink"), F.array_join("path", ">").alias("path"), "length", F.when(F.col("length") <= 5, "high").otherwise("medium").alias("confidence"))


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """Simple cycles of up to ``longest`` nodes as path, each once, from its least node."""
    step = cut(edges.select("a", "b").where("a <> b").distinct())
    paths, found = step.where("a < b").select(F.col("a").alias("start"), F.col("b").alias("at"), F.array("a", "b").alias("path")), []
    for _ in range(longest - 1):
        ring = paths.join(step.select(F.col("a").alias("at"), F.col("b").alias("start")), ["at", "start"]).select("path")
        found.append(ring)
        paths = cut(paths.join(step, F.col("at") == F.col("a")).where((F.col("b") > F.col("start")) & ~F.array_contains("path", F.col("b"))).select("start", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path")))
        if paths.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).select(F.array_join("path", ">").alias("path"), F.size("path").alias("length"))

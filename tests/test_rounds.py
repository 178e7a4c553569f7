"""Communities and PageRank on numbered nodes against plain loops: hubs in several rows, loops, missing targets, repeated edges."""

import random
import sys
from collections import Counter

from weftline.operators import graphs as grf
from weftline.plans.graph import Graph

IDS = ["b", "a", "c", "hub", "z", "lone"]
EDGES = [("hub", x) for x in "abcz"] + [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("z", "gone"), ("gone", "a")]


def graph(spark):
    return Graph(spark.createDataFrame([(i,) for i in IDS], "id string"), spark.createDataFrame(EDGES, "from_id string, to_id string"))


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(grf, "ADJACENT", 2, raising=False)
    d, n = Counter(a for a, _ in EDGES), len(IDS)
    r = dict.fromkeys(IDS, 1 / n)
    for _ in range(2):
        lost = sum(r[i] for i in IDS if not d[i])
        r = {i: 0.15 / n + 0.85 * (sum(r[a] / d[a] for a, b in EDGES if b == i and a in r) + lost / n) for i in IDS}
    got = {x.id: x.rank for x in grf.pagerank(graph(spark), 2).collect()}
    assert set(got) == set(r) and all(abs(got[i] - r[i] / max(r.values())) < 2e-6 for i in r)
    keys, edges = grf.numbered(graph(spark))
    assert [x.id for x in keys.orderBy("key").collect()] == sorted(IDS) and set(dict(edges.dtypes).values()) == {"bigint"}


def test_communities(spark, monkeypatch):
    monkeypatch.setattr(grf, "ADJACENT", 2, raising=False)
    label = {i: i for i in IDS}
    for _ in range(2):
        votes = {i: Counter() for i in IDS}
        for a, b in EDGES:
            if a != b and a in label and b in label:
                votes[a][label[b]] += 1
                votes[b][label[a]] += 1
        label = {i: min(v, key=lambda c: (-v[c], c)) if v else label[i] for i, v in votes.items()}
    assert {x.id: x.community for x in grf.label_propagation(graph(spark), 2).collect()} == label


def plain_labels(ids, edges, rounds):
    label = {i: i for i in ids}
    for _ in range(rounds):
        votes = {i: Counter() for i in ids}
        for a, b in edges:
            if a != b:
                votes[a][label[b]] += 1
                votes[b][label[a]] += 1
        label = {i: min(v, key=lambda c: (-v[c], c)) if v else label[i] for i, v in votes.items()}
    return label


def test_labels_that_return(spark, monkeypatch):
    """Labels that swap for ever end the rounds, at the right one of the two; hubs in several chunks, told by counted rows."""
    r = random.Random(5)
    ids = [f"n{i}" for i in range(40)] + ["p", "q"]
    edges = [("p", "q")] + [(r.choice(ids[:40]), r.choice(ids[:40])) for _ in range(45)] + [("n0", i) for i in ids[1:30]] + [("n3", i) for i in ids[10:30]]
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "from_id string, to_id string"))
    tables = []
    write = grf.cut
    for module in (m for m in (grf, sys.modules.get("weftline.operators.votes")) if m):
        for name in ("cut", "written"):
            monkeypatch.setattr(module, name, lambda df, what="loop": (tables.append(what), write(df, what))[1], raising=False)
    monkeypatch.setattr(sys.modules.get("weftline.operators.votes", grf), "LINKS", 4, raising=False)
    for rounds in (3, 60, 61):
        tables.clear()
        assert {x.id: x.community for x in grf.label_propagation(g, rounds).collect()} == plain_labels(ids, edges, rounds)
        assert len(tables) < 25
    assert plain_labels(ids, edges, 60) != plain_labels(ids, edges, 61) == plain_labels(ids, edges, 63)


def test_ranks_without_cycles(spark, monkeypatch):
    """What is moved ends where no edge goes on, so the rounds end early; with a cycle all of them are run."""
    tables, write = [], grf.cut
    monkeypatch.setattr(grf, "cut", lambda df, what="loop": (tables.append(what), write(df, what))[1])
    tree = [("hub", x) for x in "abcz"] + [("a", "b"), ("a", "b"), ("b", "c"), ("z", "gone")]
    for edges, most in ((tree, 9), ([*tree, ("c", "hub")], 99)):
        tables.clear()
        d, n = Counter(a for a, _ in edges), len(IDS)
        r = dict.fromkeys(IDS, 1 / n)
        for _ in range(12):
            lost = sum(r[i] for i in IDS if not d[i])
            r = {i: 0.15 / n + 0.85 * (sum(r[a] / d[a] for a, b in edges if b == i and a in r) + lost / n) for i in IDS}
        g = Graph(spark.createDataFrame([(i,) for i in IDS], "id string"), spark.createDataFrame(edges, "from_id string, to_id string"))
        got = {x.id: x["rank"] for x in grf.pagerank(g, 12).collect()}
        assert set(got) == set(r) and all(abs(got[i] - r[i] / max(r.values())) < 2e-6 for i in r)
        assert len(tables) < most

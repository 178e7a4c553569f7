"""Queries that must cover their whole tables, against plain Python on the same rows."""

from collections import Counter

from tests.test_operators import graph
from weftline import catalog
from weftline.operators import aggregates as agg
from weftline.operators import graphs as grf
from weftline.plans.graph import Graph, order_graph, table
from weftline.sources import files as src

SF = "/root/testdata/sf0.001"


def test_cycles_cover_all_nations(spark):
    edges = {(r.a, r.b) for r in catalog.trade(spark, SF).collect() if r.a != r.b}
    ids = sorted({x for e in edges for x in e})
    want = {f"{a}>{b}" for a, b in edges if a < b and (b, a) in edges}
    want |= {f"{a}>{b}>{c}" for a, b in edges for c in ids if a < b and a < c and (b, c) in edges and (c, a) in edges}
    got = [r.path for r in catalog.QUERIES["grf_21_cycles"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and max(int(x) for p in got for x in p.split(">")) > 5


def test_fix_points_cover_the_whole_graph(spark):
    g = order_graph(spark, SF)
    ids = {r.id for r in g.nodes.select("id").collect()}
    edges = [(r.from_id, r.to_id) for r in g.edges.select("from_id", "to_id").collect()]
    assert sum(r.n for r in catalog.QUERIES["grf_04_communities"](spark, SF).collect()) == len(ids)
    top = {x: x for x in ids}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r.component: r.n for r in catalog.QUERIES["grf_06_components"](spark, SF).collect()}
    assert got == Counter(map(find, ids))
    out = Counter(a for a, _ in edges)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(20):
        lost = sum(r for i, r in rank.items() if not out[i])
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * lost / len(ids))
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got, most = {r.id: r["rank"] for r in catalog.QUERIES["grf_05_pagerank"](spark, SF).collect()}, max(rank.values())
    assert got.keys() == ids and all(abs(got[i] - rank[i] / most) < 2e-6 for i in ids)


def test_labels_go_on_until_stable(spark):
    # a label moves by one node a round along a chain of pairs
    n = 12
    pairs = [(f"{i:02}", f"{i + 1:02}") for i in range(n)] + [(f"{i:02}", f"{i + 1:02}x") for i in range(n)] + [(f"{i:02}x", f"{i + 1:02}x") for i in range(n)]
    near, label = {}, {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label, rounds = {x: x for x in near}, []
    for _ in range(20):
        new = {x: min(Counter(label[y] for y in near[x]).items(), key=lambda v: (-v[1], v[0]))[0] for x in near}
        rounds.append(new != label)
        label = new
        if not rounds[-1]:
            break
    got = {r.id: r.community for r in grf.label_propagation(graph(spark, pairs)).collect()}
    assert sum(rounds) > 5 and got == label


def test_line_cursor_reads_every_document(spark):
    want = {(r.doc_id, i, len("".join(x + "\n" for x in r.text.split("\n")[:i]))) for r in table(spark, SF, "documents").collect() if r.text is not None for i in range(r.text.count("\n") + 1)}
    got = [tuple(r) for r in catalog.QUERIES["win_13_line_cursor"](spark, SF).select("doc_id", "line", "cursor").collect()]
    assert len(got) == len(want) and set(got) == want


def test_oversize_partitions_are_split(spark):
    rows = [(f"n{i:03}", "x", "N", "big" if i < 25 else "small" if i < 35 else None, None) for i in range(47)]
    g = Graph(spark.createDataFrame(rows, src.NODE_SCHEMA), None)
    got = Counter((r.partition, r["sub"]) for r in agg.split_partitions(g, 10).collect())
    assert got == {("big", 0): 10, ("big", 1): 10, ("big", 2): 5, ("small", None): 10, ("__default__", 0): 10, ("__default__", 1): 2}


def test_enrichment_reads_every_edge(spark):
    got = Counter(r.relation for r in catalog.QUERIES["rel_02_enriched"](spark, SF).select("relation").collect())
    want = Counter(r.relation for r in order_graph(spark, SF).edges.select("relation").collect())
    assert got == want and set(got) == {"BELONGS_TO", "PLACES", "CONTAINS", "SUPPLIES"}

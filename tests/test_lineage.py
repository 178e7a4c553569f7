"""Lineage and request flows on small graphs: loops, ties, hubs and searches that a data node stops."""

from weftline.operators import lineage as lin
from weftline.plans.graph import Graph


def graph(spark, edges, types):
    n = spark.createDataFrame([(i, i.upper(), t) for i, t in types.items()], "id string, name string, node_type string")
    return Graph(n, spark.createDataFrame([(*e, "high" if e[2] != "CALLS" else "medium") for e in edges], "from_id string, to_id string, relation string, confidence string"))


def plain_walk(edges, start, depth):
    """The rule as it reads: edges in stored order, the first one kept unless a later one calls."""
    path, seen = [start], {start}
    for _ in range(depth):
        best = None
        for a, b, r in sorted(edges, key=lambda e: (e[0], e[2])):
            if b == path[-1] and a not in seen and r in lin.FOLLOWED and (best is None or r == "CALLS"):
                best = a
        if best is None:
            break
        path.append(best)
        seen.add(best)
    return path[::-1]


LOOP = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("f", "c", "CONTAINS"), ("e", "c", "CALLS"), ("d", "c", "CALLS"), ("f", "e", "CONTAINS"), ("g", "e", "DEFINES"), ("d", "c", "CONTAINS"), ("z", "a", "IMPORTS"), ("c", "t", "QUERIES_TABLE"), ("b", "t", "WRITES_TABLE"), ("t", "t", "QUERIES_TABLE"), ("h", "t", "MENTIONS")]
TYPES = dict.fromkeys("abcdefghz", "FUNCTION") | {"t": "SQL_TABLE"}


def test_walks_prefer_the_last_caller_and_leave_loops(spark):
    e = graph(spark, LOOP, TYPES).edges
    for depth in (1, 2, 15):
        got = {r.id: r.path for r in lin.walks_back(e, e.selectExpr("to_id as id"), depth=depth).collect()}
        assert got == {i: plain_walk(LOOP, i, depth) for i in {b for _, b, _ in LOOP}}


def test_long_chains_and_hubs(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}", "CALLS") for i in range(30)] + [(f"m{i:03}", "n30", "CONTAINS") for i in range(200)] + [("n30", f"m{i:03}", "CALLS") for i in range(200)]
    e = graph(spark, edges, {}.fromkeys(["x"], "FUNCTION")).edges
    got = {r.id: r.path for r in lin.walks_back(e, e.selectExpr("to_id as id").distinct()).collect()}
    assert got == {i: plain_walk(edges, i, 15) for i in {b for _, b, _ in edges}} and len(got["n30"]) == 16


def test_lineage_edges_once(spark):
    g = graph(spark, LOOP, TYPES)
    chains = lin.sql_lineage(g)
    assert {(r.accessor, r.relation, ">".join(r.path)) for r in chains.collect()} == {("c", "QUERIES_TABLE", "f>e>c>t"), ("b", "WRITES_TABLE", ">".join(plain_walk(LOOP, "b", 15)) + ">t"), ("t", "QUERIES_TABLE", "t>t")}
    assert {(r.from_id, r.to_id) for r in lin.lineage_edges(chains).collect()} == {("f", "t"), (plain_walk(LOOP, "b", 15)[0], "t")}
    twice = chains.unionAll(chains)
    assert lin.lineage_edges(twice).count() == 1


def plain_search(edges, types, start, depth=8):
    from collections import deque

    out, seen, queue = [], set(), deque([(start, 0)])
    e = sorted((a, b, r) for a, b, r in edges if r in lin.FLOWS + lin.DATA_ACCESS)
    while queue:
        i, d = queue.popleft()
        if i in seen or d > depth or i not in types:
            continue
        seen.add(i)
        out.append(i)
        if types[i] in lin.DATA_TYPES:
            break
        queue.extend((b, d + 1) for a, b, _ in e if a == i and b not in seen)
    return out


def test_searches_stop_at_the_first_data_node(spark):
    edges = [("api", "h", "INVOKES"), ("api", "k", "INVOKES"), ("h", "x", "CALLS"), ("k", "a", "CALLS"), ("x", "t2", "QUERIES_TABLE"), ("a", "t1", "WRITES_TABLE"), ("x", "zz", "CALLS"), ("a", "h", "CALLS"), ("b", "b", "CALLS"), ("b", "gone", "CALLS"), ("t1", "x", "CALLS")]
    edges += [(f"n{i}", f"n{i + 1}", "CALLS") for i in range(12)] + [("tie", "p", "CALLS"), ("tie", "q", "CALLS"), ("q", "s", "CALLS"), ("p", "u", "CALLS"), ("p", "s", "CALLS")]
    types = {i: "FUNCTION" for e in edges for i in e[:2] if i != "gone"} | {"t1": "SQL_TABLE", "t2": "DATAFRAME", "api": "API_ENDPOINT"}
    g = graph(spark, edges, types)
    got = {}
    for r in lin.until_data(g, g.nodes).collect():
        got.setdefault(r.seed, []).append((r.step, r.id))
    assert {s: [i for _, i in sorted(x)] for s, x in got.items()} == {i: plain_search(edges, types, i) for i in types}
    assert sorted(got["api"])[-1][1] == "t2" and len(got["n0"]) == 9
    assert all(sorted(k for k, _ in x) == list(range(1, len(x) + 1)) for x in got.values())


def test_strategies_in_order_one_flow_a_name(spark):
    edges = [("api", "f", "INVOKES"), ("f", "t", "QUERIES_TABLE"), ("Ctl", "m", "CONTAINS"), ("m", "f", "CALLS"), ("Ctl", "lone", "CONTAINS"), ("e2", "none", "CALLS")]
    types = {"api": "API_ENDPOINT", "f": "FUNCTION", "t": "SQL_TABLE", "Ctl": "CONTROLLER", "m": "METHOD", "lone": "METHOD", "e2": "API_ENDPOINT"}
    g = graph(spark, edges, types)
    flows = spark.createDataFrame([("API", "m", 0), ("API", "f", 1), ("API", "t", 2), ("Pay", "m", 0), ("Pay", "f", 1), ("Pay", "gone", 2), ("Buy", "m", 2), ("Buy", "f", 1), ("Buy", "t", 0)], "flow_name string, id string, step int")
    got = {r.name: (r.strategy, r.steps, r.step_types, r.confidence) for r in lin.request_flows(g, lin.sql_lineage(g), flows).collect()}
    assert got == {
        "API": (1, ["API", "F", "T"], ["Controller", "Function", "Database"], "high"),
        "CTL.M": (2, ["M", "F", "T"], ["Function", "Function", "Database"], "high"),
        "SQL lineage to table 'T' via F": (3, ["CTL", "M", "F", "T"], ["Controller", "Function", "Function", "Database"], "high"),
        "Buy": (4, ["T", "F", "M"], ["Database", "Function", "Function"], "medium"),
    }
    empty = graph(spark, [], {"x": "FUNCTION"})
    assert lin.request_flows(empty, lin.sql_lineage(empty)).count() == 0


def test_steps_move_one_side(spark):
    g = graph(spark, LOOP, TYPES)
    # the best nodes before each node take one shuffle, and a table laid out for a loop none when it is joined
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(lin.predecessors(g.edges, lin.FOLLOWED, 4, g.nodes.selectExpr("id", "name", "node_type as tier"))).count("Exchange hashpartitioning") == 1
    laid = lin.placed(g.edges.select("from_id", "to_id"), "from_id")
    assert laid.count() == len(LOOP)
    joined = g.nodes.selectExpr("id as from_id").hint("merge").join(laid, "from_id")
    assert plan(joined).split("InMemoryRelation")[0].count("Exchange hashpartitioning") == 1
    laid.unpersist()


def test_repeated_rows_count_once(spark):
    edges = [("api", "f", "INVOKES"), ("f", "k", "CALLS"), ("k", "t", "QUERIES_TABLE"), ("Ctl", "m", "CONTAINS"), ("m", "f", "CALLS"), ("f", "k", "CONTAINS")]
    types = {"api": "API_ENDPOINT", "f": "FUNCTION", "k": "FUNCTION", "t": "SQL_TABLE", "Ctl": "CONTROLLER", "m": "METHOD"}
    once = graph(spark, edges, types)
    thrice = Graph(once.nodes.unionAll(once.nodes).unionAll(once.nodes), once.edges.unionAll(once.edges).unionAll(once.edges))
    told = {"API": ["API", "F", "K", "T"], "CTL.M": ["M", "F", "K", "T"], "SQL lineage to table 'T' via K": ["CTL", "M", "F", "K", "T"]}
    assert {r.name: r.steps for r in lin.request_flows(thrice, lin.sql_lineage(thrice)).collect()} == told


def plain_library(edges, types, names, most=4, enough=6):
    from collections import deque

    e = sorted(edges, key=lambda x: (x[0], x[1], x[2]))
    found = [(a, b) for a, b, r in e if r == "CONTAINS" and types.get(a) == "CLASS" and types.get(b) in ("METHOD", "FUNCTION") and not names[b].startswith("_")]
    score = lambda b: 1 + sum(3 for w in lin.INTERESTING if w in names[b].lower())
    out = {}
    for a, b in sorted(found, key=lambda x: (-score(x[1]), *x))[:most]:
        steps, seen, queue = [f"Caller → {names[a]}: {names[b]}(input)"], set(), deque([(b, names[a])])
        while queue and len(steps) < enough:
            at, actor = queue.popleft()
            if at in seen:
                continue
            seen.add(at)
            for x, y, r in e:
                if x == at and r in ("CALLS", "CALLS_API") and y in types:
                    other = next((names[p] for p, q, k in e if q == y and k == "CONTAINS" and types.get(p) == "CLASS"), "System")
                    steps += [f"{actor} → {other}: {names[y]}()", f"{other} → {actor}: return result"]
                    queue.append((y, other))
        if not any("→ Caller" in s for s in steps):
            steps.append(f"{names[a]} → Caller: return result")
        out[f"{names[a]}.{names[b]}()"] = steps
    return out


def test_library_flows_ask_until_there_are_enough_steps(spark):
    edges = [("K1", "m1", "CONTAINS"), ("K1", "m2", "CONTAINS"), ("K2", "run_it", "CONTAINS"), ("K2", "_own", "CONTAINS"), ("K3", "validate_check", "CONTAINS"), ("F", "f", "CONTAINS")]
    edges += [("validate_check", "f", "CALLS"), ("f", "validate_check", "CALLS"), ("f", "f", "CALLS"), ("run_it", "m1", "CALLS"), ("run_it", "m2", "CALLS_API"), ("m1", "run_it", "CALLS"), ("m1", "gone", "CALLS"), ("m2", "f", "CALLS"), ("m2", "f", "CALLS_API"), ("m2", "m1", "CALLS"), ("m2", "run_it", "CALLS")]
    types = {"K1": "CLASS", "K2": "CLASS", "K3": "CLASS", "F": "FILE", "f": "FUNCTION"} | dict.fromkeys(["m1", "m2", "run_it", "_own", "validate_check"], "METHOD")
    names = {i: i if i.startswith("_") else i.capitalize() for i in types}
    n = spark.createDataFrame([(i, names[i], t) for i, t in types.items()], "id string, name string, node_type string")
    g = Graph(n, graph(spark, edges, types).edges)
    for most, enough in ((4, 6), (2, 6), (9, 2), (9, 40)):
        assert {r.name: r.steps for r in lin.library_flows(g, most, enough).collect()} == plain_library(edges, types, names, most, enough)

"""Flows on small graphs: cycles, hubs, caps, missing handlers and empty tables."""

from weftline.operators import flows as flw
from weftline.plans.graph import Graph


def graph(spark, edges, nodes=None):
    ids = sorted({x for e in edges for x in e[:2]} | set(nodes or []))
    n = spark.createDataFrame([(i, i.upper(), "T", None, None) for i in ids], "id string, name string, node_type string, service string, domain string")
    return Graph(n, spark.createDataFrame([(*e, 1) for e in edges], "from_id string, to_id string, relation string, weight long"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def breadth_first(edges, start, depth):
    seen, level = {start: 0}, [start]
    for d in range(1, depth + 1):
        level = sorted({b for a, b, _ in edges if a in level} - set(seen))
        seen |= dict.fromkeys(level, d)
    return seen


RING = [("a", "b", "R"), ("b", "c", "R"), ("c", "a", "R"), ("a", "d", "R"), ("d", "e", "R"), ("e", "e", "R"), ("e", "f", "R"), ("a", "b", "R")]


def test_trace_is_breadth_first(spark):
    g = graph(spark, RING)
    for depth in (1, 2, 9):
        want = sorted((s, i, d) for s in "abcdef" for i, d in breadth_first(RING, s, depth).items())
        assert rows(flw.trace(g, flw.seeds(g.nodes), ["R"], depth)) == want


def test_capped_levels_lose_nothing(spark):
    edges = [("a", f"m{i:02}", "R") for i in range(30)] + [(f"m{i:02}", f"z{i:02}", "R") for i in range(30)] + [("b", "z00", "R"), ("z00", "z01", "R"), ("z01", "z02", "R")]
    g = graph(spark, edges)
    for most in (1, 3, 31, 40, 99):
        got = rows(flw.trace(g, flw.seeds(g.nodes.where("id in ('a', 'b')")), ["R"], 9, most=most).select("seed", "step", "id"))
        want = []
        for s in "ab":
            order = sorted(breadth_first(edges, s, 9).items(), key=lambda x: (x[1], x[0]))[:most]
            want += [(s, n, i) for n, (i, _) in enumerate(order, 1)]
        assert got == sorted(want)


def test_endpoint_flow_does_not_follow_the_endpoint(spark):
    g = graph(spark, [("h", "api", "DEFINES"), ("h", "s", "CALLS"), ("s", "api", "CALLS"), ("api", "x", "CALLS"), ("s", "t", "CALLS")], ["lonely"])
    got = rows(flw.endpoint_flows(g, g.nodes.where("id in ('api', 'lonely')"), ["DEFINES"], ["CALLS"]))
    assert got == [("api", "api", 0), ("api", "h", 1), ("api", "s", 2), ("api", "t", 3)]


def test_longest_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "b"), ("c", "d"), ("d", "d"), ("a", "b")], "a string, b string")
    assert rows(flw.longest_paths(e)) == [("a", 1, "a"), ("b", 2, "a>b"), ("c", 3, "a>b>c"), ("d", 4, "a>b>c>d"), ("x", 1, "x")]
    assert {r[1] for r in rows(flw.longest_paths(e, 2))} == {1, 2}


def test_resolve_takes_the_first_way_that_hits(spark):
    n = spark.createDataFrame([("n1", "Asia", "T", "north", None), ("n2", "x", "T", "asia", "Food"), ("n0", "y", "T", "ASIA", "n1"), ("n3", None, "T", None, None)], "id string, name string, node_type string, service string, domain string")
    g = Graph(n, spark.createDataFrame([], "from_id string, to_id string, relation string, weight long"))
    asked = spark.createDataFrame([("ASIA",), ("n1",), ("N1",), ("food",), ("none",), ("North",), ("n1",)], "query string")
    assert {r["query"]: (r["id"], r["how"]) for r in flw.resolve(g, asked).collect()} == {"ASIA": ("n1", "name"), "n1": ("n1", "id"), "N1": ("n0", "domain"), "food": ("n2", "domain"), "none": (None, None), "North": ("n1", "service")}


def test_control_edges(spark):
    n = spark.createDataFrame([(1, "run", "try: go()"), (2, "on_Error", "if (x) {}"), (3, "plain", "go()"), (4, None, None)], "id int, name string, body string")
    calls = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 2), (1, 1), (1, 9), (4, 1), (1, 2)], "from_id int, to_id int")
    assert rows(flw.control_edges(n, calls)) == [(1, 2, "CONTROL_FLOW"), (1, 2, "RETURNS_TO"), (1, 3, "CONTROL_FLOW"), (2, 3, "CONTROL_FLOW")]


def test_call_edges_prefer_functions_and_fall_back_to_files(spark):
    s = spark.createDataFrame([("p", "METHOD", "f"), ("p", "FUNCTION", "f"), ("q", "METHOD", "g"), ("q", "CLASS", "K")], "path string, category string, name string")
    calls = spark.createDataFrame([("p", "f", "q", "g"), ("p", "f", "q", "K"), ("q", "K", "p", "f"), ("p", None, "q", "g"), ("p", "f", "q", "g")], "source string, caller string, target string, callee string")
    assert rows(flw.call_edges(s, calls)) == [("FUNCTION::p::f", "METHOD::q::g", "CALLS"), ("p", "q", "DEPENDS_ON")]


def test_empty_tables(spark):
    g = graph(spark, [])
    assert rows(flw.trace(g, flw.seeds(g.nodes), ["R"], 3)) == rows(flw.trace(g, flw.seeds(g.nodes), ["R"], 3, most=2)) == []
    assert rows(flw.endpoint_flows(g, g.nodes, ["R"], ["R"])) == rows(flw.positions(g)) == rows(flw.relation_sections(g)) == rows(flw.virtual_edges(g)) == []
    assert rows(flw.longest_paths(g.edges.selectExpr("from_id a", "to_id b"))) == []


def test_detectors(spark):
    from pyspark.sql import functions as F

    from weftline.functions import rules

    t = spark.createDataFrame([("a", "f", "amqp and KafkaProducer.send"), ("a", "g", "a celery task for spark"), ("a", "hu", "a huey task"), ("b", "h", "on_event handler"), ("b", "i", "kafkaesque redis"), ("b", "j", None), ("b", "k", ""), ("c", "l", "DAG dataflow nats")], "path string, name string, t string")
    bus = rules.detected(F.col("t"), rules.BUSES, rules.BUS_NAMES, "EventBus")
    flow = rules.detected(F.col("t"), rules.PIPELINES, rules.PIPELINE_NAMES, "ETL")
    assert rows(t.select("name", F.coalesce(bus, F.lit("-")), F.coalesce(flow, F.lit("-")))) == [("f", "Kafka", "-"), ("g", "TaskQueue", "Spark"), ("h", "EventBus", "-"), ("hu", "EventBus", "-"), ("i", "-", "-"), ("j", "-", "-"), ("k", "-", "-"), ("l", "NATS", "Airflow")]
    assert rows(flw.message_edges(t, F.col("t")).select("from_key", "relation")) == [("EVENT_BUS::EventBus::b", "SUBSCRIBES_FROM"), ("a::f", "PUBLISHES_TO"), ("a::g", "CALLS"), ("c::l", "CALLS")]


def test_names(spark):
    from pyspark.sql import functions as F

    from weftline.functions import rules

    m = spark.createDataFrame([("get",), ("fetch_x",), ("checksum",), ("build_it",), ("Run_It",), ("_",), (None,)], "m string")
    # the cut is of fixed length, as in the reference, so a longer verb leaves its end behind
    got = {r[0]: r[1] for r in m.select("m", rules.described(F.col("m"))).collect()}
    assert got == {"get": "Returns data.", "fetch_x": "Returns ch x.", "checksum": "Validates input.", "build_it": "Builds it.", "Run_It": "Run it.", "_": " .", None: None}
    t = spark.createDataFrame([("user_id",), ("created_at",), ("flag",), ("x",), (None,)], "f string")
    assert {r[0]: (r[1], r[2]) for r in t.select("f", rules.type_of_name(F.col("f"), rules.SQL_TYPES, "?"), rules.type_of_name(F.col("f"), rules.PYTHON_TYPES, "str")).collect()} == {"user_id": ("INTEGER", "int"), "created_at": ("TIMESTAMP", "datetime"), "flag": ("BOOLEAN", "str"), "x": ("?", "str"), None: ("?", "str")}


def test_sequence_steps(spark):
    g = graph(spark, [("a", "b", "C"), ("a", "c", "C"), ("b", "d", "C"), ("c", "d", "W"), ("d", "a", "C"), ("a", "x", "OTHER"), ("d", "e", "W")])
    got = rows(flw.sequence_steps(g, flw.seeds(g.nodes.where("id = 'a'")), {"C": "calls", "W": "writes"}))
    assert got == [("a", 1, "a", "calls", "b"), ("a", 2, "a", "calls", "c"), ("a", 3, "b", "calls", "d"), ("a", 4, "d", "writes", "e")]
    assert rows(flw.sequence_steps(g, flw.seeds(g.nodes.where("id = 'a'")), {"C": "calls", "W": "writes"}, most=2)) == got[:2]


def test_table_links(spark):
    from weftline.catalog_flows import DEFINES, MENTIONS

    s = spark.createDataFrame([("b", "create table T1 (x int)"), ("a", "CREATE TABLE IF NOT EXISTS t1 (x int); select 1 from t9"), ("c", "select * from T1 join t1"), ("a", "insert into t1"), ("d", None)], "path string, body string")
    assert rows(flw.table_links(s, MENTIONS, DEFINES)) == [("b", "a", "t1"), ("c", "a", "t1")]

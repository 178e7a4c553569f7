"""Small graphs with answers worked out by hand."""

from weftline.operators import graphs as grf
from weftline.operators import relational as rel
from weftline.operators import windows as win
from weftline.plans.graph import Graph
from weftline.sources import files as src


def graph(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(i, i, "N", None, None) for i in ids], src.NODE_SCHEMA)
    return Graph(nodes, spark.createDataFrame([(a, b, "CALLS", 1) for a, b in pairs], src.EDGE_SCHEMA))


def test_components_and_closure(spark):
    g = graph(spark, [("1", "2"), ("2", "3"), ("5", "6")], extra=("9",))
    assert {r.id: r.component for r in grf.components(g).collect()} == {"1": "1", "2": "1", "3": "1", "5": "5", "6": "5", "9": "9"}
    tri = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "a long, b long")
    reach = {(r.a, r.b) for r in grf.closure(tri).collect()}
    assert {b for a, b in reach if a == 4} == {1, 2, 3} and {b for a, b in reach if a == 1} == {1, 2, 3}
    assert [r.path for r in grf.cycles(tri).collect()] == ["1>2>3"]


def test_integrity(spark):
    g = graph(spark, [("1", "1"), ("1", "2"), ("1", "2")])
    e = g.edges.unionByName(spark.createDataFrame([("1", "9", "CALLS", 1), ("1", "2", "IMPORTS", 1)], src.EDGE_SCHEMA))
    assert rel.with_integrity(g.nodes, e).count() == 2


def test_routes(spark):
    routes = spark.createDataFrame([("/api/users",), ("/api/users/{}",), ("/x/{}/y",)], "route string")
    calls = spark.createDataFrame([("/api/users",), ("/api/users/7/x",), ("/x/1/y",), ("/none",)], "call string")
    got = {r.call: r.route for r in rel.match_routes(calls, routes).collect()}
    assert got == {"/api/users": "/api/users", "/api/users/7/x": "/api/users", "/x/1/y": "/x/{}/y"}


def test_round_trips(spark, tmp_path):
    g = graph(spark, [("a", "b")])
    for kind in ("parquet", "json", "csv", "xml"):
        src.write_graph(g, f"{tmp_path}/{kind}", kind)
        back = src.read_graph(spark, f"{tmp_path}/{kind}", kind)
        assert back.nodes.count() == 2 and [tuple(r) for r in back.edges.collect()] == [("a", "b", "CALLS", 1)]


def test_numbers(spark):
    df = spark.range(1000).repartition(7)
    assert [r.id + 1 == r.rn for r in win.global_row_number(df, ["id"]).collect()] == [True] * 1000


def test_scan(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.txt").write_text("no")
    assert [(r.language, r.text) for r in src.scan_files(spark, str(tmp_path)).collect()] == [("python", "x = 1\n")]

"""Incremental tables, job states, exports and rules: batches with late rows, failed attempts, damaged files, failing rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators.registry import Rules
from weftline.plans.graph import Graph
from weftline.sources import graph_files as gf
from weftline.streaming.incremental import JOB_STATES, Store, job_states

CHANGE = "k long, seq long, op string, city string"
NODE = "id string, name string, node_type string, service string, domain string"
EDGE = "from_id string, to_id string, relation string, weight long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", CHANGE, "k", ["seq"], "city", removed="op = 'D'")


BATCHES = [
    [(1, 1, "I", "a"), (2, 5, "I", "a"), (3, 1, "I", "b"), (None, 9, "I", "b")],
    [(1, 3, "U", "b"), (2, 4, "U", "z"), (3, 2, "D", "b"), (4, 1, "I", None)],
    [(1, 2, "U", "q"), (3, 1, "U", "late"), (4, 2, "U", "a"), (4, 2, "U", "a")],
]


def test_batches_with_late_rows_equal_the_whole(spark, tmp_path):
    for i, b in enumerate(BATCHES):
        spark.createDataFrame(b, CHANGE).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = store(spark, tmp_path)
    for i in range(3):  # files come one after the other, as a stream meets them
        s.follow(spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/in/[0-{i}]"), f"{tmp_path}/ckpt")
    want = [(1, 3, "U", "b"), (2, 5, "I", "a"), (4, 2, "U", "a")]
    assert rows(s.table()) == want and rows(s.table(0)) == sorted(BATCHES[0][:3], key=str)
    whole = Store(spark, f"file://{tmp_path}/whole", CHANGE, "k", ["seq"], "city", removed="op = 'D'")
    whole.put(spark.createDataFrame([r for b in BATCHES for r in b], CHANGE), 0)
    assert rows(s.manifest()) == rows(whole.manifest())
    assert rows(s.changed(0)) == [("a", "changed"), ("b", "changed")] and rows(s.changed(1, 1)) == [(p, "unchanged") for p in ("__default__", "a", "b")]
    s.compact()
    assert rows(s.table()) == want
    s.put(spark.createDataFrame([(3, 1, "U", "later still")], CHANGE), 7)
    assert rows(s.table()) == want


def test_a_batch_that_fails_leaves_nothing_and_runs_again(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(spark.createDataFrame(BATCHES[0], CHANGE), 0)
    bad = spark.createDataFrame(BATCHES[1], CHANGE).withColumn("city", F.when(F.col("k") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("city")))
    with pytest.raises(Exception):
        s.put(bad, 1)
    assert rows(s.table()) == sorted(BATCHES[0][:3], key=str) and not [p for p in (tmp_path / "store" / "changes").iterdir() if "attempt" in p.name]
    for _ in range(2):  # the same batch twice
        s.put(spark.createDataFrame(BATCHES[1], CHANGE), 1)
    assert rows(s.table()) == [(1, 3, "U", "b"), (2, 5, "I", "a"), (4, 1, "I", None)]


def test_job_states_and_time_outs(spark, tmp_path):
    start = datetime(2024, 1, 1)
    days = [[(1, 0, 10, "signup"), (2, 1, 11, "view"), (3, 0, 12, "signup")], [(4, 2, 10, "view"), (5, 1, 10, "signup"), (6, 20, 11, "purchase")], [(7, 60, 13, "click"), (8, 21, 10, "error")], [(9, 95, 13, "odd"), (10, 96, 14, None)]]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for i, b in enumerate(days):
        spark.createDataFrame([(e, start + timedelta(days=d), u, k) for e, d, u, k in b], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    seen = []
    for i in range(len(days)):
        q = job_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/[0-{i}]")).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append([(r.job_id, r.state, r.n_events) for r in df.collect()])).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
    last = {}
    for batch in seen:
        for job, state, n in batch:
            last[job] = (state, n)
    assert last[11] == ("done", 2) and last[10] == ("failed", 4)
    assert last[12] == ("timed_out", 1) and last[14][0] == "running" and set(JOB_STATES.values()) == {"queued", "running", "done", "failed"}
    assert ("timed_out" in [s for b in seen for j, s, _ in b if j == 12]) and [s for b in seen for j, s, _ in b if j == 13][-1] == "running"


def small(spark):
    n = spark.createDataFrame([("1", "it's", "A", "x/y", "d"), ("2", 'say "hi", <b>', "A", None, None), ("3", "ü", "B", "x/y", None), ("4", " ", "B", "z", "d")], NODE)
    e = spark.createDataFrame([("1", "2", "R", 1), ("1", "3", "R", 2), ("3", "1", "S", 1), ("4", "2", "R", 1), ("2", "4", "R", 5)], EDGE)
    return Graph(n, e)


def test_xml_round_trip_and_last_writer(spark, tmp_path):
    g = small(spark)
    path = f"file://{tmp_path}/g"
    gf.write_graph_xml(g, path)
    back, errors = gf.read_graph_xml(spark, path)
    assert not errors and rows(back.edges) == rows(g.edges)
    assert {(r.id, r["name"], r.node_type, r.service) for r in back.nodes.collect()} == {("1", "it's", "A", "x/y"), ("2", 'say "hi", <b>', "A", None), ("3", "ü", "B", "x/y"), ("4", "", "B", "z")}
    # a later file wins; broken numbers, rows without id or ends and edges to nowhere don't count
    nodes, edges = tmp_path / "g" / "nodes", tmp_path / "g" / "edges"
    (nodes / "part-99999.xml").write_text('<Nodes><Node id="1" type="A" name="first"/><Node id="1" type="C" name="last" start_line="x"><DocString> why </DocString><Parameters><Param>p</Param><Param> q </Param></Parameters></Node><Node name="none"/></Nodes>')
    (edges / "part-99999.xml").write_text('<Edges><Edge from="1" to="9" relation="R"/><Edge from="" to="1" relation="R"/><Edge from="1" to="1" relation="R"/></Edges>')
    back, errors = gf.read_graph_xml(spark, path)
    one = back.nodes.where("id = '1'").first()
    assert not errors and (one["name"], one.node_type, one.start_line, one.docstring, one.params) == ("last", "C", 0, "why", ["p", "q"]) and rows(back.edges) == rows(g.edges)
    assert "docstring" not in gf.read_graph_xml(spark, path, children=False)[0].nodes.columns


def test_damaged_files_are_refused(spark, tmp_path):
    g = small(spark)
    path = f"file://{tmp_path}/g"
    gf.write_graph_xml(g, path)
    head = next((tmp_path / "g" / "graph").glob("part-*"))
    for crc in (tmp_path / "g" / "graph").glob(".*.crc"):
        crc.unlink()
    head.write_text(head.read_text().replace('nodes="4"', 'nodes="5"'))
    with pytest.raises(gf.CountMismatch, match="expected 5, loaded 4"):
        gf.read_graph_xml(spark, path)
    back, errors = gf.read_graph_xml(spark, path, strict=False)
    assert back.nodes.count() == 4 and errors == ["Node count mismatch: expected 5, loaded 4"]


def test_partitions_all_or_nothing(spark, tmp_path):
    g, path = small(spark), f"file://{tmp_path}/out"
    gf.export_partitions(g, path)
    x = gf.read_export(spark, path)
    assert rows(x["manifest"].drop("content_hash")) == [("__default__", 1, 0, 1), ("x_y", 2, 2, 1), ("z", 1, 0, 1)]
    assert rows(x["nodes"].select("id", "name", "partition")) == [("1", "it's", "x_y"), ("2", 'say "hi", <b>', "__default__"), ("3", "ü", "x_y"), ("4", " ", "z")]
    assert rows(x["edges"].select("from_id", "to_id")) == [("1", "3"), ("3", "1")] and x["cross_partition_edges"].count() == 3
    bad = Graph(g.nodes, g.edges.withColumn("weight", F.when(F.col("weight") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("weight"))))
    with pytest.raises(Exception):
        gf.export_partitions(bad, path)
    assert rows(gf.read_export(spark, path)["manifest"]) == rows(x["manifest"]) and [p.name for p in tmp_path.iterdir()] == ["out"]
    gf.export_statements(g, f"file://{tmp_path}/batches", size=2)
    said = {r.batch: r.statements for r in spark.read.json(f"{tmp_path}/batches/manifest").collect()}
    assert said == {"1___default__": 1, "1_x_y": 4, "1_z": 1, "2_cross_partition": 2}
    text = spark.read.text(f"{tmp_path}/batches/batches/batch=1_x_y").collect()
    assert "UNWIND [{id: '1', name: 'it\\'s', service: 'x/y', domain: 'd'}] AS row MERGE (n:A {id: row.id}) SET n += row;" in [r.value for r in text]


def test_a_failing_rule_is_data(spark):
    r = Rules()
    edge = lambda *e: spark.createDataFrame(list(e), "from_id string, to_id string, relation string")
    r.rule("one")(lambda c: edge(("a", "b", "R"), ("a", "b", "R"), (c, "x", "R")))
    r.rule("no column")(lambda c: edge(("a", "b", "R")).select("nothing"))
    r.rule("in a task")(lambda c: edge(("q", "b", "R")).withColumn("to_id", F.raise_error(F.lit("late"))))
    r.rule("python")(lambda c: {}["k"])
    r.rule("two")(lambda c: edge(("a", "b", "R"), ("b", "c", "S")))
    pytest.raises(ValueError, r.rule, "two")
    edges, report = r.run(spark, "ctx")
    assert rows(edges) == [("a", "b", "R", "one"), ("b", "c", "S", "two"), ("ctx", "x", "R", "one")]
    assert [(q.rule, q.edges, q.error is None) for q in report.orderBy("position").collect()] == [("one", 2, True), ("no column", 0, False), ("in a task", 0, False), ("python", 0, False), ("two", 2, True)]
    assert Rules().run(spark, None)[0].count() == 0


def test_an_export_leaves_no_shuffle(spark, tmp_path):
    """The edges meet their partitions in one job whose shuffle files go with it, and what is exported is compressed."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in files.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    g = small(spark)
    wide = spark.range(40000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("x").alias("name"), F.lit("A").alias("node_type"), F.col("id").cast("string").substr(1, 1).alias("service"), F.lit("d").alias("domain"))
    nodes = wide.select(*g.nodes.columns)
    edges = wide.select(F.col("id").alias("from_id"), F.lit("n7").alias("to_id"), F.lit("R").alias("relation"), F.lit(1).cast("long").alias("weight"))
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = held()
        gf.export_partitions(Graph(nodes, edges), f"file://{tmp_path}/out")
        left = held() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    x = gf.read_export(spark, f"file://{tmp_path}/out")
    assert x["edges"].count() + x["cross_partition_edges"].count() == 40000 and not left
    assert {p.suffix for p in (tmp_path / "out" / "edges").rglob("part-*")} == {".gz"}

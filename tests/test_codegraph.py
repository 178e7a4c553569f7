"""The code base and its graph: files read once by a stack, against windows over lines; nothing but names shuffled; many tasks for few rows."""

from tests.compare import differences
from tests.test_links import FILE
from weftline import catalog
from weftline.operators import scopes
from weftline.plans import codebase
from weftline.plans.codegraph import build, code_graph

SF = "/root/testdata/sf0.001"
TS = "export async function a(x) {\n  if (x) {\n    class B {\n      m(y) {\n      }\n    }\n    b(1);\n  }\n  function c() {}\n}\nfunction d() { }\n"
ODD = [("p", "python", FILE), ("t", "typescript", TS), ("e", "python", ""), ("n", "python", None), ("l", None, "class A\n\t{ def b(c\n}}\n @x\n"), ("s", "sql", "Create  VIEW if not exists a {\n  create table b (\n}\nupdate b\n"), ("w", "python", " \n@a \n#\n  @b\n def é(): x\n def f(): g() f()\n def f(): f()\r\n\x0b class f: g(f(")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stack_agrees_with_windows(spark):
    f = spark.createDataFrame(ODD, "path string, language string, text string")
    ln = scopes.lines(f)
    decl = scopes.with_ends(ln, scopes.declarations(ln))
    g = build(f)
    want = scopes.symbols(ln, decl)
    assert rows(g.symbols.select(want.columns)) == rows(want) and want.count() > 15
    assert rows(g.owned) == rows(scopes.owners(ln, decl).select(g.owned.columns))


def test_lines_are_not_shuffled(spark):
    g = code_graph(spark, SF)
    for df in (g.symbols, g.owned):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_few_rows_make_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(codebase, "FILES_A_TASK", 50, raising=False)
    assert codebase.source_files(spark, SF).rdd.getNumPartitions() > 6


def test_code_graph_equals_sql(spark):
    for name in ("ext_01_symbols", "ext_01_owned_lines", "src_02_code_nodes", "rel_07_code_edges", "rel_08_calls"):
        assert not differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF), name


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_suffixes_broadcast_nothing(spark):
    f = catalog.QUERIES["rel_43_comment_context"]
    assert "BroadcastHashJoin" not in plan(f(spark, SF)) and not differences(spark, f, catalog.ORACLES["rel_43_comment_context"], SF)


def test_usages_repeat_only_common_words(spark):
    from weftline.sources import code

    f = spark.createDataFrame([(f"p{i:02}", f"class C{i} def hot {'x' if i % 2 else ''}") for i in range(40)] + [("q", "class x hot C3")], "path string, text string")
    want = sorted({(f"p{i:02}", f"p{j:02}", "hot") for i in range(40) for j in range(40) if i != j} | {(f"p{i:02}", "q", "hot") for i in range(40)} | {("q", f"p{j:02}", "x") for j in range(1, 40, 2)} | {("p03", "q", "C3")})
    for share in (3, 1000):
        assert rows(code.usages(f, share)) == want
    whole = catalog.QUERIES["rel_17_usages"](spark, SF)
    assert "SortMergeJoin [name" in plan(whole)
    assert not differences(spark, catalog.QUERIES["rel_17_usages"], catalog.ORACLES["rel_17_usages"], SF)


def test_contents_and_measures_stay_in_their_rows(spark):
    assert "Exchange" not in plan(catalog.QUERIES["doc_24_contents"](spark, SF))
    for name in ("doc_24_contents", "agg_20_code_complexity"):
        assert not differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF), name


def test_the_scan_tells_calls_and_accesses_once(spark):
    text = "def a(x):\n  b(1); b(2); a(3)\n  run('select x from T join t')\ndef b(y):\n  far(y)\nupdate u\n"
    r = scopes.scanned(spark.createDataFrame([("p", "python", text)], "path string, language string, text string")).first()
    assert [tuple(c) for c in r.calls] == [("a", "b", "b"), ("a", "a", "a"), ("a", "run", None), ("b", "far", None)]
    assert [tuple(u) for u in r.uses] == [("a", "t", "QUERIES_TABLE"), (None, "u", "WRITES_TABLE")]
    shuffled = sum(x in plan(code_graph(spark, SF).scanned.select("calls", "uses")) for x in ("Exchange", "text#"))
    assert not shuffled


def test_sources_are_shuffled_once_a_file(spark):
    from weftline.catalog_source import contexts

    p = plan(contexts(code_graph(spark, SF)))
    assert p.count("Exchange hashpartitioning") <= 5
    for name in ("ctx_11_compressed", "ctx_12_trimmed"):
        assert not differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF), name


def test_artifacts_come_from_the_scan(spark):
    f = catalog.QUERIES["rel_34_artifact_flows"]
    assert not any("regexp_extract_all" in x for x in plan(f(spark, SF)).splitlines())
    written = []
    from weftline.operators import links

    keep, links.cut = links.cut, lambda df, *a: written.append(plan(df)) or keep(df, *a)
    try:
        f(spark, SF)
    finally:
        links.cut = keep
    assert written and not any("regexp_extract_all" in p for p in written)
    assert not differences(spark, f, catalog.ORACLES["rel_34_artifact_flows"], SF)


def test_order_edges_shuffle_keys(spark):
    from weftline.plans.graph import planned_graph

    assert "_groupingexpression" not in plan(planned_graph(spark, SF).edges)

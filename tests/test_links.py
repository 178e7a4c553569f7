"""Links by prefixes, suffixes, parents and shared items against plain loops; scopes on small files."""

import itertools

from weftline.operators import links as lnk
from weftline.operators import scopes
from weftline.plans.graph import Graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


ROUTES = [("/api/users", "a"), ("/api/users/", "b"), ("/api/users/{id}", "c"), ("/api", "c"), ("/", "z"), ("/x/y/z", "d"), ("/x/y/z", "e"), ("/api/u", "f"), ("", "q")]
CALLS = [(p, u) for p in "abcz" for u in ["/api/users", "/api/users/7/", "/api/us", "/x", "/x/y/z//", "/nope", "", "/apis", "/", "/x/y/zz"]]


def plain_match(path, url, routes, other_file):
    last = {}
    for pattern, file in sorted(routes):
        last[pattern] = file
    u = url.rstrip("/")
    for pattern in sorted(last):
        r = pattern.rstrip("/")
        if (last[pattern] != path or not other_file) and (u == r or u.startswith(r) or r.startswith(u)):
            return last[pattern], pattern
    return None


def test_prefixes_both_ways(spark):
    calls = spark.createDataFrame([*CALLS, CALLS[0]], "path string, url string")
    for own, routes in itertools.product((True, False), (ROUTES, ROUTES[:4], ROUTES[5:6], [])):
        r = spark.createDataFrame(routes, "pattern string, path string")
        want = sorted((p, u, *m) for p, u in set(CALLS) if (m := plain_match(p, u, routes, own)))
        got = lnk.first_prefix_match(calls, r, other_file=own)
        assert rows(got) == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_react_edges_and_endpoints_agree(spark):
    n = spark.createDataFrame([("f", "f", "FILE", "f"), ("f::A", "A", "REACT_COMPONENT", "f"), ("f::B", "B", "CLASS", "f"), ("g::A", "A", "REACT_COMPONENT", "g"), ("h::useX", "useX", "REACT_HOOK", "h"), ("api::/a", "/a", "API_ENDPOINT", None)], "id string, name string, node_type string, path string")
    m = spark.createDataFrame([("f", "A", "hook", "useX"), ("f", "A", "hook", "useY"), ("f", "A", "element", "A"), ("g", "A", "element", "A"), ("f", "B", "call", "/a/1"), ("f", None, "call", "/new"), ("f", "q", "call", "/new"), ("f", "q", "call", "/")], "path string, owner string, kind string, name string")
    edges, new = lnk.react_links(None, n, m)
    assert rows(edges) == [("f", "api::/a", "CALLS_API"), ("f", "api::/new", "CALLS_API"), ("f::A", "g::A", "RENDERS"), ("f::A", "h::useX", "USES_HOOK"), ("f::B", "api::/a", "CALLS_API")]
    ids = {r[0] for r in rows(n.select("id"))} | {r[0] for r in rows(new)}
    assert rows(new) == [("api::/new", "/new", "API_ENDPOINT", "http")] and all(a in ids and b in ids for a, b, _ in rows(edges))


def test_suffixes_of_paths(spark):
    n = spark.createDataFrame([("3", "run", "b/c.py"), ("1", "run", "c.py"), ("2", "run", ".py"), ("4", "run", None), ("5", "run", ""), ("6", "go", "c.py"), ("0", "run", "x/b/c.py")], "id string, name string, path string")
    asked = spark.createDataFrame([("/a/b/c.py", "run"), ("c.py", "run"), ("zc.py", "go"), ("c.pyx", "run"), ("/a/b/c.py", "run")], "source string, name string")
    assert rows(lnk.by_path_suffix(asked, n)) == [("/a/b/c.py", "run", "1"), ("c.py", "run", "1"), ("zc.py", "go", "6")]


def test_comment_context_keeps_ten_lines(spark):
    n = spark.createDataFrame([("1", "run", "c.py", "doc", None, "", "t1, t2"), *[(f"k{i:02}", f"K{i:02}", "k.py", None, "d", None, None) for i in range(12)]], "id string, name string, path string, docstring string, business_domain string, service string, tags string")
    e = spark.createDataFrame([("1", f"k{i:02}", "CALLS", 1) for i in range(12)] + [("1", "gone", "A", 1)], "from_id string, to_id string, relation string, weight int")
    got = lnk.comment_context(Graph(n, e), spark.createDataFrame([("/r/c.py", "run"), ("/r/k.py", "K01"), ("/r/q", "K01")], "source string, name string"))
    assert rows(got.select("name", "context")) == [("K01", "Business Domain: d"), ("run", "\n".join(["Documentation: doc", "Tags: t1, t2", *(f"→ CALLS: K{i:02}" for i in range(8))]))]


def test_ancestors_up_to_four(spark):
    chain = [(f"n{i}", f"N{i}", f"n{i - 1}" if i else None) for i in range(8)] + [("m", "uses PyMongo", None), ("loop", "L", "loop"), ("lost", "x", "gone"), ("null", None, None)]
    n = spark.createDataFrame(chain, "id string, name string, parent_id string")
    for at in range(8):
        got = {r.id for r in lnk.in_context(n, spark.createDataFrame([(f"n{at}",), ("gone",)], "id string")).collect() if r.inside}
        assert got == {f"n{i}" for i in range(at, min(at + 5, 8))} | {"m"}, at
    assert {r.id for r in lnk.in_context(n, spark.createDataFrame([("loop",)], "id string")).collect() if r.inside} == {"loop", "m"}


def test_one_item_that_all_share(spark):
    makes = [(f"a{i}", f"c{i}") for i in range(60)] + [("hot", "c0"), ("a1", "c9")]
    uses = [("hot", f"c{i}") for i in range(60)] + [("a3", "c5"), ("a3", "c3"), ("none", "c1"), ("hot", "other")]
    s = lambda r: spark.createDataFrame(r, "artifact string, component string")
    got = rows(lnk.artifact_flows(s(makes), s(uses), spark.createDataFrame([("Z", "c0"), ("Y", "c0"), ("W", "c5")], "name string, component string")))
    made = {}
    for a, c in makes:
        made[a] = min(made.get(a, c), c)
    service = {"c0": "Z", "c5": "W"}
    want = sorted({(a, b, service.get(made[a], f"{made[a]} Service"), service.get(c, f"{c} Service")) for a, c in uses if a in made for b, m in made.items() if m == c and a != b})
    assert got == want and ("a3", "a5", "c3 Service", "W") in got


FILE = '''@app.get("/x")
# why

@other
class A(Base):
    """doc"""
    def f(self, x=(1)):
        def g(): pass
        y = 1

# a comment at the edge
        z = 2
x = 1
if x:
    def h():
        return q(1)
  
class B: pass'''


def test_scopes_of_indents_and_braces(spark):
    ts = "export async function a(x) {\n  if (x) {\n    class B {\n      m(y) {\n      }\n    }\n    b(1);\n  }\n  function c() {}\n}\nfunction d() { }\n"
    f = spark.createDataFrame([("p", "python", FILE), ("t", "typescript", ts), ("e", "python", ""), ("n", "python", None)], "path string, language string, text string")
    ln = scopes.lines(f)
    decl = scopes.with_ends(ln, scopes.declarations(ln))
    got = {(r.path, r.qualified): (r.kind, r.line_no, r.end_line, r.decorator) for r in scopes.symbols(ln, decl).collect()}
    assert got == {
        ("p", "A"): ("CLASS", 5, 12, "@other"), ("p", "A.f"): ("METHOD", 7, 12, None), ("p", "A.f.g"): ("FUNCTION", 8, 8, None), ("p", "h"): ("FUNCTION", 15, 17, None), ("p", "B"): ("CLASS", 18, 18, None),
        ("t", "a"): ("FUNCTION", 1, 10, None), ("t", "a.B"): ("CLASS", 3, 6, None), ("t", "a.B.m"): ("METHOD", 4, 5, None), ("t", "a.c"): ("FUNCTION", 9, 9, None), ("t", "d"): ("FUNCTION", 11, 12, None),
    }
    own = {(r.path, r.line_no): r.owner for r in scopes.owners(ln, decl).collect()}
    assert own["p", 12] == "f" and own["p", 13] is None and own["p", 16] == "h" and own["t", 7] == "a" and own["p", 5] is None and ("p", 11) not in own

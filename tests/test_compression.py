"""Compression by the rules as they read, over budgets from nothing to plenty."""

import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import compression as cmp

SPECIAL = "{}[]()=<>:;,./\\|@#$%^&*~`"


def tokens(parts):
    text = " ".join(t for p in parts if p for t in p)
    return int(len(text.split()) * 1.3) + int(sum(c in SPECIAL for c in text) * 0.3)


def plain_compressed(head, neighbours, edges, related, source, budget):
    est = lambda: tokens([head, neighbours, edges, related, source])
    m = max(5, len(neighbours) // 2)
    while est() > budget and m > 3:
        neighbours = neighbours[:m]
        m //= 2
    m = max(10, len(edges) // 2)
    while est() > budget and m > 5:
        edges = edges[:m]
        m //= 2
    if est() > budget:
        related = related[:3]
    cut = est() > budget and bool(source)
    if cut:
        source = [*source[: max(20, len(source) // 2)], "... [truncated]"]
    return neighbours, edges, related, source, cut, est()


def plain_trimmed(parts, budget, order):
    parts = dict(parts)
    for s in order:
        if tokens(parts.values()) <= budget:
            break
        if parts[s] is None:
            continue
        a = parts[s]
        if len(a) > 2:
            while len(a) > 1 and tokens(parts.values()) > budget:
                a = a[: len(a) // 2]
                parts[s] = a
        if tokens(parts.values()) > budget:
            parts[s] = None
    return parts


def made(n):
    return [[f"n{i} (x) = {i};" for i in range(k)] for k in (2, n, 3 * n, n // 4, 2 * n)]


NAMES = ["head", "neighbours", "edges", "related", "source"]


@pytest.mark.parametrize("n", [0, 1, 7, 40])
def test_steps_as_in_the_rule(spark, n):
    budgets = [0, 5, 20, 60, 120, 200, 300, 450, 700, 10_000]
    rows = [(b, *made(n)) for b in budgets]
    d = spark.createDataFrame(rows, "budget int, " + ", ".join(f"{c} array<string>" for c in NAMES)).select("budget", *(cmp.items(F.col(c)).alias(c) for c in NAMES))
    for r in cmp.compressed(d, "budget").collect():
        got = [[x.text for x in r[c]] for c in NAMES[1:]]
        assert (*got, r.truncated, r.tokens) == plain_compressed(*made(n), r.budget), (n, r.budget)


@pytest.mark.parametrize("budget", [0, 3, 10, 30, 100, 180, 260, 5000])
def test_sections_go_by_priority(spark, budget):
    order = ["semantic_neighbors", "related_functions", "target"]
    parts = [{"query": ["what is it?"], "target": ["a (b)"], "semantic_neighbors": [f"k{i}: x.y" for i in range(30)], "related_functions": [f"f{i}(z)" for i in range(9)]}, {"query": [], "target": None, "semantic_neighbors": ["one", "two"], "related_functions": []}]
    d = spark.createDataFrame([tuple(p.values()) for p in parts], ", ".join(f"{c} array<string>" for c in parts[0]))
    d = d.select(*(F.when(F.col(c).isNotNull(), cmp.items(F.col(c))).alias(c) for c in d.columns))
    got = [{c: None if r[c] is None else [x.text for x in r[c]] for c in parts[0]} | {"tokens": r.tokens} for r in cmp.trimmed(d, budget).collect()]
    want = []
    for p in parts:
        left = plain_trimmed(p, budget, order)
        want.append(left | {"tokens": tokens(left.values())})
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_special_characters_are_the_estimators(spark):
    text = "a{b}[c](d)=<e>:;,./\\|@#$%^&*~` \n x"
    r = spark.range(1).select(cmp.item(F.lit(text)).alias("i")).first().i
    assert r.words == len(text.split()) and r.special == sum(c in SPECIAL for c in text) and re.fullmatch(r"\S+ \n x", text)

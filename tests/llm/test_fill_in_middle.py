"""Fill-in-middle against a plain version, with other units and sentinels and odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import fill_in_middle as fim

DOCS = "doc_id long, text string, n long, form string, prefix string, _blocks long"
TEXTS = [None, "", "a", "é", "😀", "a\nb\r\n c", "has <P> in it", "<S>", "<", "x<P", "no break", "😀é" * 100, "w " * 3000, "<" * 500, "<M" * 90, "tail<"]


def plain_version(doc_id, text, seed, plain, spm, sentinels, unit):
    t = text or ""
    u = re.findall(unit, t, re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    a, b, c = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    p, s, m = sentinels
    if not t or any(x in t for x in sentinels) or h3 % 100 >= 100 - plain:
        return (doc_id, len(u), "plain", a, b, t)
    if h4 % 100 < spm:
        return (doc_id, len(u), "spm", a, b, s + c + p + a + m + b)
    return (doc_id, len(u), "psm", a, b, p + a + s + c + m + b)


@pytest.mark.parametrize("seed,plain,spm,sentinels,unit,width", [("1", 10, 20, fim.SENTINELS, fim.CODE_POINT, 64), ("x", 0, 50, ("[pre]", "[suf]", "[mid]"), fim.CODE_POINT, 3), ("2", 0, 100, fim.SENTINELS, "[^ \n]+|[ \n]+", 4), ("3", 50, 0, ("␀p", "␀s", "␀m"), fim.CODE_POINT, 1)])
def test_by_a_plain_version(spark, seed, plain, spm, sentinels, unit, width):
    if sentinels[0].startswith("["):
        pytest.raises(ValueError, fim._checked, ("[a[", "b", "c"))
    rows = [(i, t) for i in range(12) for t in TEXTS] + [(None, "no id"), (3, "a"), (3, "a")]
    d = spark.createDataFrame([(i, t, 9, "f", "p", 7) for i, t in rows], DOCS)
    got = fim.arranged(d, seed, plain, spm, sentinels, unit, width).withColumn("back", fim.restored(F.col("output"), F.col("form"), sentinels)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix, r.middle, r.output) for r in got) == Counter(plain_version(i, t, seed, plain, spm, sentinels, unit) for i, t in rows)
    assert all(r.back == r.text for r in got) and {r.form for r in got} >= {"plain"}


def test_no_python_and_odd_tables(spark):
    d = spark.createDataFrame([(1, "long " * 400_000, 0, "", "", 0)], DOCS)
    out = fim.arranged(d, plain=0, carry=["_blocks"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    row = out.select("n", "_blocks", (fim.restored(F.col("output"), F.col("form")) == F.col("text")).alias("same")).first()
    assert row.n == 2_000_000 and row.same
    assert fim.arranged(d.limit(0)).count() == 0

"""Toxicity: features by a plain version, trees and the isotonic curve by their definitions, held-out documents, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import toxicity as tox

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score double, x long, y long, ratio long"
LEX = tox.Lexicon({"idiot": 1.0, "scum": 0.5, "brutt*": 0.25})


def test_features_of_small_texts():
    def of(text):
        return dict(zip(tox.FEATURES, tox.profile(text, LEX)))

    a = of("You idiot, you SCUM!! Why?")
    assert a["hits"] == 2 / 5 and a["weight"] == 1.5 / 5 and a["near_share"] == 1.0 and a["most_in_span"] == 2 and a["shouted"] == 1 / 5 and a["exclamations"] == 100 * 2 / 26 and a["questions"] == 100 / 26
    for text in ("1d1ot", "id!ot", "i.d.i.o.t", "i d i o t", "idiooot", "id*ot", "(1diot)", "$cum", "s-c-u-m"):
        b = of(f"plain {text} words")
        assert b["hits"] > 0 and b["disguises"] > 0, text
    for text in ("idiotic", "ID 10", "a.b.c.d", "scumble", "e-mail"):
        assert of(text)["hits"] == 0, text
    assert of("bruttel and brutt")["weight"] == 0.25 / 3 and of("a br.utt.en b")["disguised_hits"] > 0
    far = of("you " + "word " * 30 + "idiot")
    assert far["near_share"] == 0.0 and far["hits"] == 1 / 32
    assert set(of("").values()) == {0.0}


def test_long_texts_are_read_in_slices(monkeypatch):
    r = np.random.default_rng(2)
    text = " ".join(r.choice(["idiot", "you", "a", "Word", "b!", "1d1ot", "x.y"], 5000))
    whole = tox.profile(text, LEX)
    monkeypatch.setattr(tox, "SLICE", 997)
    assert np.allclose(tox.profile(text, LEX), whole)
    assert tox.profile("z" * 5000, LEX)[0] == 0.0


def test_trees_learn_an_interaction_and_ties():
    r = np.random.default_rng(0)
    x = r.integers(0, 5, (2000, 4)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 1)).astype(float)
    t = tox.boost(x[:1500], y[:1500], rounds=60)
    assert ((t.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.99
    assert np.allclose(tox.boost(x[:10], y[:10], rounds=3).raw(x[:0]), [])
    flat = tox.boost(np.zeros((30, 2)), np.repeat([0.0, 1.0], 15), rounds=4)
    assert np.allclose(flat.raw(np.ones((3, 2))), 0.0)


def test_isotonic_is_the_best_rising_curve():
    from itertools import product

    raw, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    centres, values = tox.isotonic(raw, y, least=1)
    got = ((np.repeat(values, [1, 3, 2][: len(values)]) - y) ** 2).sum() if len(values) == 3 else None
    best = min(((np.array(c) - y) ** 2).sum() for c in product(np.linspace(0, 1, 13), repeat=6) if list(c) == sorted(c))
    assert np.all(np.diff(values) > 0) and got is not None and got <= best + 1e-9
    assert centres.tolist() == [0.0, 2.0, 4.5]


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit(docs, labels.where(~tox.held_out(F.col("doc_id"))))
    # lang, source and doc_id don't matter
    other = docs.withColumn("doc_id", F.col("doc_id") + 10**9).withColumn("lang", F.lit("xx"))
    a, b = ({r.doc_id % 10**9: r.score for r in tox.score(d, model).collect()} for d in (docs, other))
    assert a == b and all(0 <= s <= 1 for s in a.values())
    truth = {r.doc_id: r.toxic for r in labels.where(tox.held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).collect() if r.doc_id in a}
    caught = [t for i, t in truth.items() if a[i] >= 0.7]
    assert len(caught) >= 5 and np.mean(caught) >= 0.9


def test_odd_rows(spark):
    rows = [(1, "you idiot scum"), (1, "you idiot scum"), (2, None), (3, ""), (None, "x"), (4, "w " * 200_000), (5, "\x00 ␀ é"), (6, "nice day")]
    d = spark.createDataFrame([(i, t, 1.0, 2, 3, 4) for i, t in rows], DOCS)
    for labels in ([], [(1, 1)], [(1, None), (None, 1)], [(1, 1), (6, 0), (6, 0), (2, 0), (4, 1), (9, 1)]):
        model = tox.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"), max_fit=50)
        got = tox.score(d, model, carry=["x", "ratio"]).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and (r.x, r.ratio) == (2, 4) for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
        if len(labels) < 4:
            assert {r.score for r in got} == {1.0 if labels == [(1, 1)] else 0.5}
    assert tox.score(d.limit(0), model).count() == 0


@pytest.mark.parametrize("copies", [1, 40])
def test_copies_make_no_lexicon(spark, copies):
    r = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows = [(i, " ".join(r.choice(words, 40)), 0) for i in range(200)] + [(1000 + i, " ".join([*r.choice(words, 30), *r.permutation(["worstword", "badword", *words[:8], f"sluff{words[i]}"])]), 1) for i in range(20)]
    rows += [(5000 + i, "only these words stand here alone " * 3, 1) for i in range(copies)]
    lexicon = tox.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert {"worstword", "badword", "sluffb*"} <= set(lexicon.weight) and "stand" not in lexicon.weight

"""Each stage of the pipeline against a plain version on the stage's own input, and the run as a whole."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from weftline.llm import packing, pii, quality_classifier
from weftline.llm import shared as S

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PAIR_LEAST = 80


def words(t):
    return WORD.findall(t or "")


def near_kept(rows):
    """Least doc_id of each group of documents linked by shingles of five words."""
    sets, root = {}, {}
    for r in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(r.text)]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[r.doc_id] = r.doc_id

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= PAIR_LEAST * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x for x in root if root[x] == x}


def passages_kept(rows):
    """Words that no window of 13 takes out, by doc_id."""
    least, out = {}, {}
    for r in rows:
        w = words(r.text)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    for r in rows:
        w = words(r.text)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < r.doc_id:
                gone[i : i + 13] = True
        out[r.doc_id] = [x for x, g in zip(w, gone) if not g]
    return out


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    inputs = [docs]
    for name, stage in pipe.STAGES[:-1]:
        inputs.append(S.materialize(stage(spark, inputs[-1], SF), "test-" + name.replace(" ", "-")))
        assert inputs[-1].columns == names
    rows = [d.collect() for d in inputs]

    # quality: exactly the documents at 0.7 or more, unchanged
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~S.held_out(F.col("doc_id")))
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if scores[r.doc_id] >= 0.7) and 0 < len(rows[1]) < len(rows[0])
    # near copies: whole rows of the least of each group
    kept = near_kept(rows[1])
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r.doc_id in kept)
    # passages: every document stays, without the windows that a smaller doc_id has
    assert {r.doc_id: words(r.text) for r in rows[3]} == passages_kept(rows[2])
    # personal data: no base span is left, and texts without any span stay as they were
    before = {r.doc_id: r.text for r in rows[3]}
    assert {r.doc_id for r in rows[4]} == set(before)
    for r in rows[4]:
        assert not [x for x in pii.base_spans(r.text or "")]
        assert r.text == before[r.doc_id] or "[" in r.text
        assert r.n_chars == len(r.text)
    # packing: the run as a whole gives the ids of what the stages left, in gapless sequences
    tok, fill, got = Tokenizer.from_file(packing.default_tokenizer()), {}, {}
    for r in sorted(pipe.run(spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        got.setdefault(r.doc_id, []).append(r)
    assert max(fill.values()) <= 2048 and set(got) == {r.doc_id for r in rows[4]}
    for r in rows[4]:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(got[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)

"""Operators against plain versions, and the odd rows that they define."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from weftline.llm import embedding_dedup, language_id, minhash_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece_ops, substring_dedup, suffix_dedup
from weftline.llm import shared as S

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n long, rep long, v long, key long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], DOCS)


def least_reachable(links, nodes):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in nodes}


def near_rows(seed):
    """Chains and groups of near copies, some with an equal doc_id."""
    r = np.random.default_rng(seed)
    rows = []
    for group in range(6):
        text = [f"g{group}w{i}" for i in r.integers(0, 40, 30)]
        for _ in range(12):
            for _ in range(int(r.integers(0, 3))):
                text[int(r.integers(0, 30))] = f"x{int(r.integers(0, 9))}"
            rows.append((int(r.integers(0, 60)), " ".join(text)))
    return [*rows, (61, None), (62, ""), (63, "one"), (64, "ONE"), (None, "one"), (63, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PART", 4)  # buckets of several parts
    rows = near_rows(seed)
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)))
    real = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for (a, s), (b, t) in combinations(real, 2) if 100 * len(s & t) >= 80 * len(s | t)]
    comp = least_reachable(links, {i for i, _ in real})
    want = Counter((i, len(s), comp[i] if s and i is not None else i, i is None or not s or comp[i] == i) for i, s in sets)
    got = minhash_dedup.near_duplicates(frame(spark, rows), size=2, pivots=2, bands=60).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_equal_doc_ids_share_links(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = minhash_dedup.near_duplicates(frame(spark, [(1, a), (3, b), (3, a + " more"), (5, b + " more"), (7, b)]), size=2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (3, 1), (5, 1), (7, 1)}


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_bits_are_counted(bits):
    r = np.random.default_rng(bits)
    low = r.integers(0, 1 << bits, (50, 37))
    x = minhash_dedup.pack_bits(low, bits)
    for i in range(50):
        assert minhash_dedup.equal_fields(x[i], x, 37, bits).tolist() == (low[i] == low).sum(1).tolist()


def test_parity_sketch_is_a_lower_bound(spark):
    texts = [f"{i % 3} " + " ".join(f"w{j}" for j in range(i, i + 50)) for i in range(20)]
    t = pa.table({"v": list(range(20)), "text": texts})
    rows = list(minhash_dedup._sketches(2)(t.to_batches()[0]))[0]
    sets = [set(zip(x.split(), x.split()[1:])) for x in texts]
    bits = [np.frombuffer(b, np.uint8) for b in rows["sketch"].to_pylist()]
    for i, j in combinations(range(20), 2):
        assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(sets[i] ^ sets[j])
    assert [len(s) for s in sets] == rows["n"].tolist()


@pytest.mark.parametrize("window,first", [(13, 4), (13, 13), (10, 1), (40, 4)])
def test_doubling_by_brute_force(spark, window, first):
    r = np.random.default_rng(window)
    shared = [" ".join(f"s{k}_{i}" for i in range(80)) for k in range(4)]
    rows = []
    for i in range(60):
        k, a = int(r.integers(0, 4)), int(r.integers(0, 60))
        own = [f"o{int(x)}" for x in r.integers(0, 6, 30)]
        rows.append((int(r.integers(0, 50)), " ".join([*own, *shared[k].split()[a : a + int(r.integers(5, 80))], *own])))
    rows += [rows[0], rows[0], (None, rows[0][1]), (70, None), (71, " \n"), (72, " ".join(["a"] * 100)), (73, " ".join(["a"] * 90)), (74, shared[0] + " " + " ".join(f"u{i}" for i in range(9000)))]
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                least[k] = min(least.get(k, i), i)
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone[s : s + window] = True
        want[(i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    got = substring_dedup.substring_dedup(frame(spark, rows), window=window, first=first, layout="words").collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want


def test_suffixes_by_brute_force_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 3000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    long = "".join(chr(97 + int(x)) for x in np.random.default_rng(0).integers(0, 26, 200_000))
    rows += [(rows[5][0], rows[6][1]), rows[7], rows[7], (None, rows[3][1]), (9001, "z" * 5000), (9002, "z" * 4000), (9003, long), (9004, "é" + long[:100_000]), (9005, None), (9006, "")]
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                least[b[p : p + 50]] = min(least.get(b[p : p + 50], i), i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if i is not None and least[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest())] += 1
    got = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == want


@pytest.mark.parametrize("n", [0, 1, 50, 20000])
def test_multikey_quicksort(n):
    r = np.random.default_rng(n)
    columns = [r.integers(-2, 2, n) for _ in range(4)]
    order, new = suffix_dedup.multikey_quicksort(columns, cutoff=16)
    rows = list(zip(*(c.tolist() for c in columns)))
    got = [rows[i] for i in order]
    assert got == sorted(rows) and sorted(order.tolist()) == list(range(n))
    assert new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(n)]


def test_vectors_by_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(500, 32))
    v = np.concatenate([base, base[:250] + 0.06 * r.normal(size=(250, 32)), base[:250] + 0.09 * r.normal(size=(250, 32)), base[0] + 0.02 * r.normal(size=(60, 32))])
    rows = [(i, x.tolist(), i % 2, 0, 0) for i, x in enumerate(v)] + [(None, v[1].tolist(), 1, 0, 0), (None, v[7].tolist(), 1, 0, 0), (5, v[5].tolist(), 1, 0, 0), (2000, [1e200] * 32, 0, 0, 0), (2001, [2e200] * 32, 0, 0, 0)]
    x = np.array([e for _, e, *_ in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k[2] for k in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid long, m long")
    got = Counter((q.vec_id, q.n_links) for q in embedding_dedup.embedding_dedup(d).collect())
    want = Counter((k[0], int(n)) for k, n in zip(rows, near.sum(1)))
    found = sum(min(a[1], a[1]) * n for a, n in got.items()) / sum(a[1] * n for a, n in want.items())
    assert 0.99 <= found <= 1 and got[(None, int(near[1].sum()))] >= 1 and got[(2000, 1)] == 1
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_dedup(empty).count() == 0


def test_threshold_is_met_exactly(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(2, 16))
    x[1] = x[0] + 0.2 * x[1]
    u = embedding_dedup._unit(x)
    tie = float((u[:1] @ u.T)[0, 1])
    rows = [(1, x[0].tolist(), 1), (2, x[1].tolist(), 1), (3, x[0].tolist(), 1), (4, x[1].tolist(), 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for threshold, links in ((tie - 1e-12, [2, 2, 2, 0]), (tie + 1e-12, [1, 0, 1, 0])):
        got = {q.vec_id: q for q in embedding_dedup.embedding_dedup(d, threshold=threshold).collect()}
        assert [got[i].n_links for i in (1, 2, 3, 4)] == links and got[3].component_id == 1


def test_language_by_a_dictionary(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()][:80]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(d, language_id.fit(d)).collect()}

    def grams(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    counts, number = defaultdict(Counter), Counter()
    for r in rows:
        if r.lang is not None and r.text is not None:
            counts[r.lang].update(grams(r.text))
            number[r.lang] += 1
    size, agree = 1 << 16, 0
    for r in rows:
        score = {k: math.log(number[k] / sum(number.values())) + sum(math.log((c[g] + 0.1) / (sum(c.values()) + 0.1 * size)) for g in grams(r.text)) for k, c in sorted(counts.items())}
        agree += got[r.doc_id].lang_pred == max(score, key=score.get)
    assert agree >= 0.97 * len(rows)  # the operator's grams share buckets now and then


def test_quality_by_plain_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~S.held_out(F.col("doc_id")))
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    net, buckets = model.net, len(model.seen)
    for r in docs.limit(60).collect():
        data, off = S.text_bytes(pa.array([r.text]))
        tokens = quality_classifier.token_buckets(data, off, 0, 1, buckets)[0].tolist()
        n, dims = len(tokens), model.vectors.shape[1]
        x = [0.0] * (dims + 5)
        for b in tokens:
            for k in range(dims):
                x[k] += float(model.vectors[b, k]) / n
            x[dims + 1] += (not model.seen[b]) / n
        x[dims] = math.sqrt(sum(v * v for v in x[:dims]))
        x[dims + 2] = math.log1p(n)
        for k in (1, 2):
            x[dims + 2 + k] = sum(a == b for a, b in zip(tokens, tokens[k:])) / n if n else 0.0
        z = np.clip((np.array(x) - net["mean"]) / net["std"], -8, 8)
        logit = float(np.maximum(z @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"][0]) / net["t"]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-logit))) < 1e-4
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").where(S.held_out(F.col("doc_id"))).collect() if r.quality is not None}
    good, bad = ([got[i] for i, q in truth.items() if q == y and i in got] for y in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9


def test_equal_doc_ids_do_not_widen_the_sample(spark):
    d = frame(spark, [(1, "good text here")] * 30 + [(2, "bad ! ! !")] * 30)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.score(d, quality_classifier.fit(d, labels, max_fit=2)).count() == 60


def test_base_spans_by_plain_re():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    r = np.random.default_rng(9)
    parts = ["a", "Z", "@", ".", "-", "+", " ", "1", "25", "255", "256", "4111111111111111", "(", ")", "é", "x.y", "@b.co", "+1 (555) 010-99 88", "10.0.0.1"]
    for _ in range(20000):
        t = "".join(parts[i] for i in r.integers(0, len(parts), int(r.integers(1, 14))))
        want = [(0, m.start(), m.end()) for m in email.finditer(t)]
        want += [(1, m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(2, m.start(), m.end()) for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [(3, m.start(), m.end()) for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == want, t


def test_any_number_of_characters(spark):
    import sentencepiece

    text = "".join(chr(c) for c in range(0x21, 0x20000) if not 0xD800 <= c < 0xE000 and c != 0x2581)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_ops.default_model())
    data, off = S.text_bytes(pa.array([text]))
    (_, _, ids, _), = sentencepiece_ops.Encoder(sentencepiece_ops.default_model()).batch(data, off)
    assert ids.tolist() == sp.encode(text)


def test_other_tokenizers_are_refused(tmp_path):
    import json

    j = json.load(open(packing.default_tokenizer()))
    j["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(j))
    with pytest.raises(ValueError):
        packing.UnitEncoder(str(tmp_path / "t.json"), 1)


def test_empty_tables_and_repeated_rows(spark):
    empty = frame(spark, [])
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, minhash_dedup.near_duplicates):
        assert f(empty).count() == 0
    rows = [(1, "a b c d " * 9), (1, "a b c d " * 9), (2, None), (3, "")]
    d = frame(spark, rows).withColumn("lang", F.lit("en"))
    got = quality_rules.quality_rules(d).collect()
    assert len(got) == 4 and len({tuple(r) for r in got if r.doc_id == 1}) == 1


def test_stages_on_odd_rows(spark):
    odd = [(1, "one two three four five six seven", "en"), (1, "one two three four five six seven", "en"), (2, None, None), (3, "", "en"), (None, "mail a@b.co now", "en"), (4, " ".join(f"w{i}" for i in range(30000)), "de")]
    d = spark.createDataFrame([(i, t, k, "s", None if t is None else len(t), 7, 8) for i, t, k in odd], "doc_id long, text string, lang string, source string, n_chars long, score long, key long")
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and out.dtypes == d.dtypes and out.count() <= len(odd), name
        assert stage(spark, d.limit(0), SF).count() == 0
    assert pipe.STAGES[-1][1](spark, d, SF).select("doc_id").distinct().count() == 5
    near = pipe.near_copies(spark, d, SF)
    assert near.where("doc_id is null").count() == 1 and near.where("doc_id = 2").count() == 1

"""Odd rows through every operator, and brute force where SQL can't say what is right."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import differences
from weftline.llm import catalog, embedding_dedup, language_id, minhash_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece_ops, substring_dedup, suffix_dedup
from weftline.llm import shared as S

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20000))
TEXTS = [None, "", " \n\t ", "one", LONG, LONG, "a b c " * 40, "a b c " * 40, "mail bob@example.com or +1 (743) 555-3824 now", "x" * 3000, "日本 テキスト é 😀"]
DOCS = "doc_id long, text string, lang string, score double, kept boolean, key string"


def docs(spark, rows=None):
    rows = [(i, t, "en" if i % 2 else None, 0.5, True, "k") for i, t in enumerate(TEXTS)] + [(None, "no id here", "en", 0.1, False, "k"), (3, "one", "en", 0.1, False, "k")] if rows is None else rows
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    assert not differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    d = docs(spark, [] if empty else None)
    n = 0 if empty else len(TEXTS) + 2
    assert quality_rules.quality_rules(d).count() == n
    lang = {r.doc_id: r for r in language_id.predict(d, language_id.fit(d)).collect()}
    assert len(lang) == (0 if empty else len(TEXTS) + 1)
    if not empty:
        assert lang[0].lang_pred == "und" and lang[0].score == 0 and lang[3].lang_pred == "en"
    labels = spark.createDataFrame([] if empty else [(4, 1, 0), (6, 0, 0), (8, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    scores = quality_classifier.score(d, quality_classifier.fit(d, labels)).collect()
    assert len(scores) == n and all(0 <= r.score <= 1 for r in scores)
    near = {(r.doc_id, r.n_shingles): r for r in minhash_dedup.near_duplicates(d, size=2).collect()}
    if not empty:
        assert near[(0, 0)].component_id == 0 and near[(5, 19999)].component_id == 4 and not near[(5, 19999)].kept and near[(None, 2)].kept
    cut = {r.doc_id: r for r in substring_dedup.substring_dedup(d, layout="words").collect()}
    if not empty:
        assert cut[5].n_removed == 20000 and cut[4].n_removed == 0 and cut[7].kept_text == "" and cut[None].kept_text == "no id here"
    found = {r.doc_id: r for r in pii.find_pii(d, pii.fit(d), redact=True).collect()}
    if not empty:
        assert [s.kind for s in found[8].base] == ["email", "phone"] and found[8].redacted_text == "mail [EMAIL] or [PHONE] now" and found[0].redacted_text is None
    assert sum(1 for _ in packing.pack_documents(d, packing.default_tokenizer()).select("doc_id").distinct().toLocalIterator()) == len({r.doc_id for r in d.collect()})
    enc = sentencepiece_ops.encode(d, sentencepiece_ops.default_model(), round_trip=True)
    assert enc.count() == n and enc.where("not round_trip").count() == 0


def test_suffixes_by_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank again and again. "
    texts = [base * 3, "x" + base * 2 + "y", base[:49], base[:50], base[10:70] + "é" + base, None, "z" * 120, "z" * 90, base * 3]
    rows = [(i, t, None, 0.0, True, "k") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.suffix_dedup(docs(spark, rows)).collect()}
    first: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        assert got[i] == (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest())


def test_suffix_dedup_table(spark):
    assert suffix_dedup.op9(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    tok, got = Tokenizer.from_file(packing.default_tokenizer()), {}
    rows = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), packing.default_tokenizer(), capacity=256).collect()
    fill: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert all(v <= 256 and v & (v - 1) == 0 for v in fill.values())
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert sum((x for _, x in sorted(got[r.doc_id])), []) == tok.encode(r.text, add_special_tokens=False).ids + [1]


def test_units_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, encoder = Tokenizer.from_file(path), packing.UnitEncoder(path, 1, most=40)
    texts = [t or "" for t in TEXTS] + ["don't 'S ''s it's<|endoftext|>x <|ENDOFTEXT|> <| |>", "İst ÉÀ × a×b ÷ ß ſ ǅ x\u00a0y", "12a34-- a—.b e\u0301a \u0301x №5 ²x", "\x1c\x85a b\u2028c ŉ ¿qué? ª º µ a\x00b"]
    data, off = S.text_bytes(pa.array(texts))
    for lo, hi in S.pieces(off, 200):
        ids, sizes = encoder.rows(data, off, lo, hi)
        ends = np.cumsum(sizes)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts[lo:hi]]


def test_sentencepiece_equals_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_ops.default_model())
    texts = [t or "" for t in TEXTS if t != LONG] + ["  Hello  world\n\tThe ▁x ﬁ é", "<s> <0x0A> " * 9, " " * 50 + "a"]
    data, off = S.text_bytes(pa.array(texts))
    for lo, hi, ids, counts in sentencepiece_ops.Encoder(sentencepiece_ops.default_model()).batch(data, off):
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == sp.encode(texts[lo:hi])


def test_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in d.collect()}
    rows = [r for r in language_id.op1(spark, SF).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.9


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16)).astype(np.float32)
    v = [*base, *(base[:20] + 0.05 * r.normal(size=(20, 16)).astype(np.float32)), base[0]]
    rows = [(i, [float(x) for x in e], 1) for i, e in enumerate(v)] + [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [float(x) for x in base[0]], None)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array(v, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert all(got[i].n_links == int(n) - 1 for i, n in enumerate((x @ x.T >= 0.93).sum(1)))
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103)) and got[60].component_id == 0

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams per language over a bounded sample of labelled rows
(``max_fit`` documents by a hash of doc_id, all of their text); the
log-probability matrix of ``buckets`` x languages is broadcast.  Scoring
treats a batch as a sparse matrix whose row pointers are the documents and whose
column numbers are the n-grams' buckets, repeats not merged, and multiplies it with the
matrix by a gather and a segmented sum.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, or when no
language was learned; equal scores go to the language first in the alphabet;
repeated rows get the same result each; a very long text is a piece of its own; an empty table gives an empty table; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray
    sizes: tuple[int, ...]


def gram_buckets(data: np.ndarray, off: np.ndarray, lo: int, hi: int, sizes, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: buckets of the n-grams of rows lo..hi in order, and the first gram of each row with an end mark."""
    part, row_off = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
    chars = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
    first = np.searchsorted(chars[:-1], row_off)
    roll = S.Rolling(S._byte_values(5, True)[part], 5)
    out = []
    for n in sizes:
        counts = np.maximum(np.diff(first) - n + 1, 0)
        mark = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(mark[-1]) + np.repeat(first[:-1] - mark[:-1], counts)
        h = roll.runs(chars[at], chars[at + n]) + S.U64(n)
        out.append(((h & S.U64(buckets - 1)).astype(np.int64), mark))
    return out


def bounded_sample(docs: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of doc_id; all rows when there are fewer."""
    n = docs.count()
    if n <= most:
        return docs
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * (most / n)))


def fit(docs: DataFrame, max_fit: int = 16000, buckets: int = 1 << 16, sizes=(1, 2, 3), smoothing: float = 0.1, parts: int = 8) -> Model:
    """Counts per language of rows with a text and a lang."""
    ids = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    rows = bounded_sample(ids, max_fit).repartition(parts)

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            langs = t["lang"].to_pylist()
            data, off = S.text_bytes(t["text"])
            for lo, hi in S.pieces(off):
                names = np.array(langs[lo:hi])
                for b, mark in gram_buckets(data, off, lo, hi, sizes, buckets):
                    row = np.repeat(np.arange(hi - lo), np.diff(mark))
                    for lang in sorted(set(langs[lo:hi])):
                        c = seen.setdefault(lang, np.zeros(buckets, np.int64))
                        c += np.bincount(b[(names == lang)[row]], minlength=buckets)
            for lang in langs:
                number[lang] = number.get(lang, 0) + 1
        for lang in sorted(seen):
            at = np.flatnonzero(seen[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[lang][at], number[lang]), pa.int64())], names=["lang", "bucket", "n"])

    S.ship(docs.sparkSession)
    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    counts, prior = np.full((buckets, max(1, len(langs))), smoothing), np.ones(max(1, len(langs)))
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), i] += grams["n"].to_numpy()
        prior[i] = own.loc[own["bucket"] < 0, "n"].sum()
    return Model(langs, np.log(counts / counts.sum(0)).astype(np.float32), np.log(prior / prior.sum()), tuple(sizes))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the most probable language of each whole text and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        m = shared.value
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        letter = np.zeros(256, np.int64)
        letter[65:91] = letter[97:123] = 1
        for lo, hi in S.pieces(off):
            n = hi - lo
            score = np.tile(m.log_prior, (n, 1))
            for b, mark in gram_buckets(data, off, lo, hi, m.sizes, len(m.log_prob)):
                full = np.flatnonzero(np.diff(mark))
                if len(full):
                    score[full] += np.add.reduceat(m.log_prob[b], mark[:-1][full], axis=0, dtype=np.float64)
            best = score.argmax(1)
            p = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
            sums = np.concatenate([[0], np.cumsum(letter[data[off[lo] : off[hi]]])])
            known = np.diff(sums[off[lo : hi + 1] - off[lo]]) > 0
            for i in np.flatnonzero(~known):
                known[i] = any(c.isalpha() for c in data[off[lo + i] : off[lo + i + 1]].tobytes().decode("utf-8", "replace"))
            known &= bool(m.languages)
            names = [m.languages[j] if k else UNKNOWN for j, k in zip(best.tolist(), known.tolist())]
            yield {"doc_id": t["doc_id"][lo:hi], "lang_pred": names, "score": np.where(known, p, 0.0)}

    return S.map_arrow(S.texts(docs), work, "doc_id long, lang_pred string, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~S.held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

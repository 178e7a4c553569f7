"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Random indexing: a token's bucket has a fixed sparse vector of +1 and -1; the
vector of a word is the sum of those of its neighbours over the fitting sample,
scaled to length 1.  A document is the mean vector of its tokens, with the mean's
length, the share of tokens never seen in fitting, the log of the length and the shares of
tokens that repeat one of the two before.  A
two-layer network gives the probability of label 1; a temperature found on
rows kept aside calibrates it.

The sample is bounded by ``max_fit`` labelled documents, chosen by a hash of doc_id; all
of their text is used.  Word vectors and network are of fixed size and broadcast.

Defined cases: null text is empty and gets the score of a document without tokens;
labels that are null are ignored, several labels of a document count by their mean; with no
label, or one class only, the score is the labels' mean (0.5 without any); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Byte classes: white space, letters with all non-ASCII bytes, digits, and each other sign by itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[S.SPACE] = 0
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 65
CLASS[48:58] = 48


@dataclass
class Model:
    vectors: np.ndarray | None  # buckets x dims
    seen: np.ndarray | None
    net: dict | None
    constant: float


def token_buckets(data, off, lo, hi, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of rows lo..hi, and the first token of each row with an end mark."""
    part, row_off = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
    c = CLASS[part]
    first = c != 0
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    inner = row_off[1:-1]
    new[inner[inner < len(c)]] = True
    start = np.flatnonzero(first & new)
    edge = np.append(np.flatnonzero(new), len(c))
    end = edge[np.searchsorted(edge, start, side="right")] if len(start) else start
    h = S.Rolling(S._byte_values(9, False)[part], 9).runs(start, end)
    return (h & S.U64(buckets - 1)).astype(np.int64), np.searchsorted(start, row_off)


def index_vectors(buckets: int, dims: int, nonzero: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, dims, (buckets, nonzero)), r.choice([-1.0, 1.0], (buckets, nonzero))


def features(b: np.ndarray, mark: np.ndarray, vectors: np.ndarray, seen: np.ndarray) -> np.ndarray:
    n, d = len(mark) - 1, vectors.shape[1]
    out = np.zeros((n, d + 5))
    counts = np.diff(mark)
    full = np.flatnonzero(counts)
    place = np.arange(len(b)) - np.repeat(mark[:-1], counts)
    if len(full):
        out[full, :d] = np.add.reduceat(vectors[b], mark[:-1][full], axis=0, dtype=np.float64) / counts[full, None]
        out[full, d + 1] = np.add.reduceat((~seen[b]).astype(np.float64), mark[:-1][full]) / counts[full]
        for k in (1, 2):  # tokens that repeat the one before, or the one before that
            same = np.zeros(len(b))
            same[k:] = b[k:] == b[:-k]
            same[place < k] = 0.0  # not across the edge of a row
            out[full, d + 2 + k] = np.add.reduceat(same, mark[:-1][full]) / counts[full]
    out[:, d] = np.sqrt((out[:, :d] ** 2).sum(1))
    out[:, d + 2] = np.log1p(counts)
    return out


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> dict:
    """Two layers by Adam; the last fifth, in a fixed shuffle, sets the temperature."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(x))
    cut = max(1, len(x) * 4 // 5)
    mean, std = x[order[:cut]].mean(0), x[order[:cut]].std(0) + 1e-6
    z = np.clip((x - mean) / std, -8, 8)
    p = {"w1": r.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), "b1": np.zeros(hidden), "w2": r.normal(0, (1 / hidden) ** 0.5, hidden), "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        o = r.permutation(order[:cut])
        for i in range(0, len(o), 128):
            s = o[i : i + 128]
            a = np.maximum(z[s] @ p["w1"] + p["b1"], 0)
            g = (1 / (1 + np.exp(-(a @ p["w2"] + p["b2"]))) - y[s]) / len(s)
            da = np.outer(g, p["w2"]) * (a > 0)
            grad = {"w1": z[s].T @ da + 1e-4 * p["w1"], "b1": da.sum(0), "w2": a.T @ g + 1e-4 * p["w2"], "b2": np.array([g.sum()])}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = p | {"mean": mean, "std": std, "t": 1.0}
    aside = order[cut:] if cut < len(x) else order
    logit = logits(x[aside], net)

    def loss(t):
        return np.mean(np.logaddexp(0, logit / t) - y[aside] * logit / t)

    net["t"] = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def logits(x: np.ndarray, net: dict) -> np.ndarray:
    z = np.clip((x - net["mean"]) / net["std"], -8, 8)
    return (np.maximum(z @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"]) / net["t"]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit: int = 8000, buckets: int = 1 << 14, dims: int = 48, nonzero: int = 4, reach: int = 2, parts: int = 8) -> Model:
    """Fit on documents whose doc_id has a label; ``max_fit`` bounds how many, and of rows with an equal doc_id the least text serves."""
    from .language_id import bounded_sample

    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = S.materialize(bounded_sample(known, max_fit).repartition(1), "chosen")  # max_fit rows at most
    sample = S.materialize(S.texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y").repartition(parts), "sample")
    place, sign = index_vectors(buckets, dims, nonzero)

    def neighbours(batches):
        total, seen = np.zeros(buckets * dims), np.zeros(buckets, np.int64)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            data, off = S.text_bytes(t["text"])
            for lo, hi in S.pieces(off):
                b, mark = token_buckets(data, off, lo, hi, buckets)
                row = np.repeat(np.arange(hi - lo), np.diff(mark))
                seen += np.bincount(b, minlength=buckets)
                for o in range(1, reach + 1):
                    same = row[o:] == row[:-o]
                    left, right = b[:-o][same], b[o:][same]
                    for w, c in ((left, right), (right, left)):
                        at = (w * dims)[:, None] + place[c]
                        total += np.bincount(at.ravel(), weights=sign[c].ravel(), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names=["v", "n"])

    S.ship(docs.sparkSession)
    got = sample.mapInArrow(neighbours, "v binary, n binary").collect()  # one row of fixed size for each part
    vectors = np.sum([np.frombuffer(r.v, "<f4").astype(np.float64) for r in got], axis=0).reshape(buckets, dims) if got else np.zeros((buckets, dims))
    seen = np.sum([np.frombuffer(r.n, "<i8") for r in got], axis=0) > 0 if got else np.zeros(buckets, bool)
    vectors = (vectors / np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)

    def pooled(batch):
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        for lo, hi in S.pieces(off):
            x = features(*token_buckets(data, off, lo, hi, buckets), vectors, seen)
            yield {"doc_id": t["doc_id"][lo:hi], "y": t["y"][lo:hi], "x": S.list_array(x.ravel(), np.full(hi - lo, x.shape[1]), pa.float64())}

    rows = S.map_arrow(sample, pooled, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = rows["y"].to_numpy(float)
    if len(rows) < 2 or y.min() == y.max():
        return Model(vectors, seen, None, float(y.mean()) if len(rows) else 0.5)
    return Model(vectors, seen, train(np.stack(rows["x"].to_numpy()), y), 0.0)


def score(docs: DataFrame, model: Model, carry=()) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text, and the columns named in ``carry``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        m = shared.value
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        for lo, hi in S.pieces(off):
            if m.net is None:
                p = np.full(hi - lo, m.constant)
            else:
                p = 1 / (1 + np.exp(-np.clip(logits(features(*token_buckets(data, off, lo, hi, len(m.vectors)), m.vectors, m.seen), m.net), -60, 60)))
            yield {"doc_id": t["doc_id"][lo:hi], "score": p, **{c: t[c][lo:hi] for c in carry}}

    return S.map_arrow(S.texts(docs, *(c for c in carry if c != "text")), work, "doc_id long, score double" + S.carried(docs, carry))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~S.held_out(F.col("doc_id")))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

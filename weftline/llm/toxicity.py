"""Toxicity: gradient-boosted trees over a few dense features, calibrated by isotonic regression.

The lexicon is learned from labelled rows: words and beginnings of words whose share of toxic documents is higher than
chance lets expect among that many, by the likelihood ratio; near copies (an equal least hash of three words) count once. A text's features are
the densities of lexicon words, plain and disguised, the most of them within 50 words, how many stand near a word of the
second person, capitals, punctuation and the rate of disguises: letters replaced by signs, masked, spaced out or drawn out.

Trees of fixed depth are boosted on the logistic loss over binned features. Predictions of each fifth of the rows by trees
that the other four have fitted are the ground for the isotonic curve; the score is read off it between the blocks' centres.

The sample is bounded by ``max_fit`` labelled documents, chosen by a hash of doc_id; the lexicon by ``words``. Both and the
trees are of fixed size and broadcast.

Defined cases: null text is empty and gets the score of a document without words; a null doc_id is scored, but never
learned from; rows with an equal doc_id are each scored by their own text, and of such a doc_id the least text is learned from; null
labels are ignored, several labels of a document count by their mean; with no label, or one class only, the score is the
labels' mean (0.5 without any); equal likelihood ratios go by word; texts of any length are read in slices of ``SLICE``
characters, cut at white space where there is any in reach; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Characters of a text that are looked at together.
SLICE = 1 << 17
#: Words of the second person, in the languages that the lexicon may be of.
SECOND_PERSON = frozenset(
    ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "deiner", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"]
)
NEAR, SPAN = 5, 50
#: Letters of the beginnings that the lexicon may have, and words whose weight a worker keeps at hand.
STEMS, KNOWN = range(4, 9), 1 << 17
#: Least hashes that near copies are told by; one of similarity 0.8 shares none with a chance of 0.2 ** 4.
COPY_HASHES = 4
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"(?<!\S)(?=\S{0,20}[0-9@$!|*._-][^\W\d_])\S{2,24}(?!\S)")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,15}[^\W\d_](?![^\W_])")
DRAWN = re.compile(r"([^\W\d_])\1{2,}")
SHOUTED = re.compile(r"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
FEATURES = ["hits", "weight", "disguised_hits", "near_share", "near_hits", "most_in_span", "log_hits", "second_person", "capitals", "shouted", "exclamations", "questions", "signs", "disguises", "log_words"]


def held_out(doc_id) -> F.Column:
    """True where crc32(doc_id as text) mod 3 is 1; such rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


@dataclass
class Lexicon:
    """Weights (0 to 1) of words, and of beginnings of longer words: those end with a star."""

    weight: dict[str, float]
    masked: dict[str, str] = field(init=False)
    known: dict[str, float] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.masked = {w[:i] + "*" + w[i + 1 :]: w for w in sorted(self.weight, reverse=True) if len(w) > 3 and w[-1] != "*" for i in range(1, len(w))}

    def find(self, word: str) -> float:
        """The greatest weight that a word's own entry or one of its beginnings has; 0 without any."""
        found = self.known.get(word)
        if found is None:
            found = max(self.weight.get(word, 0.0), *(self.weight.get(word[:k] + "*", 0.0) if len(word) > k else 0.0 for k in STEMS))
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[word] = found
        return found

    def plain(self, token: str) -> str | None:
        """The word of the lexicon that a disguised token stands for."""
        token = token.strip(".,;:?\"'()[]-_")
        if "*" in token:
            return self.masked.get(token)
        word = "".join(WORD.findall(token.translate(LEET)))
        return word if self.find(word) else None


def slices(text: str):
    lo = 0
    while lo < len(text):
        hi = lo + SLICE
        if hi < len(text):
            cut = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi))
            hi = cut + 1 if cut > lo else hi
        yield text[lo:hi]
        lo = hi


def profile(text: str, lexicon: Lexicon) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    find = lexicon.find
    words = disguised = disguises = shouted = 0
    weighed = 0.0
    hits, persons = array("q"), array("q")
    signs = np.zeros(256, np.int64)

    def plain(m):
        nonlocal disguised, disguises
        word = lexicon.plain(m[0])
        disguises += 1
        disguised += word is not None
        return word or m[0]

    def closed(m):
        nonlocal disguised, disguises
        word = re.sub(r"[ .*_-]", "", m[0])
        disguises += 1
        hit = find(word) > 0
        disguised += hit
        return word if hit else m[0]

    def short(m):
        nonlocal disguises
        disguises += 1
        return m[1]

    for piece in slices(text):
        signs += np.bincount(np.frombuffer(piece.encode("utf-8", "replace"), np.uint8), minlength=256)
        shouted += len(SHOUTED.findall(piece))
        low = DRAWN.sub(short, piece.lower())
        low = SPACED.sub(closed, DISGUISED.sub(plain, low))
        found = WORD.findall(low)
        for i, w in enumerate(found, words):
            weight = find(w)
            if weight:
                hits.append(i)
                weighed += weight
            elif w in SECOND_PERSON:
                persons.append(i)
        words += len(found)
    n, chars = max(words, 1), max(int(signs.sum()), 1)
    letters = max(int(signs[65:91].sum() + signs[97:123].sum()), 1)
    h, p = np.array(hits, np.int64), np.array(persons, np.int64)
    near = int((np.searchsorted(p, h + NEAR, side="right") > np.searchsorted(p, h - NEAR)).sum()) if len(h) else 0
    most = int((np.searchsorted(h, h + SPAN) - np.arange(len(h))).max()) if len(h) else 0
    rest = signs[33:48].sum() + signs[58:65].sum() + signs[91:97].sum() + signs[123:127].sum() - signs[33] - signs[63] - signs[44] - signs[46]
    return [
        len(h) / n, weighed / n, disguised / n, near / max(len(h), 1), near / n, float(most), float(np.log1p(len(h))), len(p) / n, float(signs[65:91].sum()) / letters, shouted / n,
        100.0 * float(signs[33]) / chars, 100.0 * float(signs[63]) / chars, float(rest) / chars, disguises / n, float(np.log1p(words)),
    ]


# --- boosted trees ---------------------------------------------------------------------
@dataclass
class Trees:
    start: float
    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # the node's threshold: greater values go right
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, a, leaf in zip(self.feature, self.above, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, f[at]] > a[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Trees on the logistic loss; a node splits where the gain over the bins of all features is largest, first of equals."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    n, d = x.shape
    inner = 2**depth - 1
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    raw = np.full(n, start)
    all_f, all_a, all_leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        f, a, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((at - first)[:, None] * d + np.arange(d)) * bins + binned
            size = width * d * bins
            gs = np.bincount(key.ravel(), weights=np.repeat(g, d), minlength=size).reshape(width, d, bins).cumsum(2)
            hs = np.bincount(key.ravel(), weights=np.repeat(h, d), minlength=size).reshape(width, d, bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = 0.0
            for k in range(width):
                j, b = np.unravel_index(int(gain[k].argmax()), (d, bins))
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + k], a[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > a[at])
        leaf_g, leaf_h = (np.bincount(at - inner, weights=v, minlength=inner + 1) for v in (g, h))
        leaf = -rate * leaf_g / (leaf_h + ridge)
        raw = raw + leaf[at - inner]
        all_f.append(f)
        all_a.append(a)
        all_leaf.append(leaf)
    return Trees(start, np.array(all_f), np.array(all_a), np.array(all_leaf))


def isotonic(raw: np.ndarray, y: np.ndarray, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of blocks of rising means: runs of about ``least`` rows, equal values together, pooled while a mean falls."""
    order = np.argsort(raw, kind="stable")
    raw, y = raw[order], y[order]
    step = max(1, min(least, len(raw) // least))
    at = np.arange(0, len(raw), step)
    at = np.unique(np.searchsorted(raw, raw[at], side="left"))
    blocks: list[list[float]] = []  # sum of y, sum of raw, rows
    for lo, hi in zip(at, np.append(at[1:], len(raw))):
        blocks.append([y[lo:hi].sum(), raw[lo:hi].sum(), hi - lo])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    b = np.array(blocks, float)
    return b[:, 1] / b[:, 2], b[:, 0] / b[:, 2]


# --- fitting and scoring -----------------------------------------------------------------
@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    centres: np.ndarray
    values: np.ndarray
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.interp(self.trees.raw(x), self.centres, self.values)


def learn_lexicon(sample: DataFrame, words: int = 256) -> Lexicon:
    """Words of three letters or more, and their beginnings, that tell toxic rows of sample (doc_id, text, y) beyond chance, with a weight of 0 to 1.

    Each counts once a document. With V of them that two toxic documents hold, one passes if its likelihood ratio
    exceeds what the best of V without any bearing would reach.
    """
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}{3,})"), 1)
    d = sample.select("doc_id", "y", w.alias("w"))
    once = d
    for seed in range(COPY_HASHES):  # of rows that share a least hash, the first stays
        least = F.array_min(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.slice("w", i, 3), F.lit(seed))))  # noqa: B023
        copy = F.when(F.size("w") > 3, least).otherwise(F.xxhash64("w", "doc_id"))
        once = once.groupBy(copy.alias("copy"), "y").agg(F.min_by(F.struct("doc_id", "w"), "doc_id").alias("d")).select("d.doc_id", "y", "d.w")
    once = S.materialize(once.withColumn("w", F.array_distinct("w")), "once")
    all_, bad = once.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not bad or bad == all_:
        S.drop_table(once)
        return Lexicon({})
    stems = F.flatten(F.transform("w", lambda x: F.array_compact(F.array(x, *(F.when(F.length(x) > k, F.concat(F.substring(x, 1, k), F.lit("*"))) for k in STEMS)))))
    counts = once.select("y", F.explode(F.array_distinct(stems)).alias("word")).groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("n")).where("t >= 2")
    part = lambda k, e: F.when(k > 0, k * F.ln(k / e)).otherwise(0.0)
    t, n = F.col("t").cast("double"), F.col("n").cast("double")
    tests = [(t, n * bad / all_), (n - t, n * (all_ - bad) / all_), (bad - t, (all_ - n) * bad / all_), (all_ - bad - n + t, (all_ - n) * (all_ - bad) / all_)]
    ratio = 2 * sum((part(k, e) for k, e in tests), F.lit(0.0))
    told = S.materialize(counts.where(t / n > bad / all_).withColumn("ratio", ratio), "told")
    bound = 2 * float(np.log(max(told.count(), 2))) + 3
    best = told.where(F.col("ratio") > bound).orderBy(F.desc("ratio"), "word").limit(8 * words).collect()  # a bounded list
    for table in (told, once):
        S.drop_table(table)
    # a beginning that stands in the documents of one longer entry alone says no more than that one
    known = sorted((r["word"].rstrip("*"), r["t"], r["n"]) for r in best)
    longer = {(w[:k], t, n) for w, t, n in known for k in STEMS if k < len(w)}
    kept = [r for r in best if not (r["word"].endswith("*") and (r["word"][:-1], r["t"], r["n"]) in longer)]
    return Lexicon({r["word"]: r["t"] / r["n"] for r in kept[:words]})


def _profiles(docs: DataFrame, lexicon: Lexicon, carry: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(batch):
        t = pa.Table.from_batches([batch])
        x = np.array([profile(v.as_py() or "", shared.value) for v in t["text"]])
        yield {"x": S.list_array(x.ravel(), np.full(len(x), x.shape[1]), pa.float64()), **{c: t[c] for c in carry}}

    return S.map_arrow(docs, work, "x array<double>" + S.carried(docs, carry))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_fit: int = 8000, words: int = 256, parts: int = 8) -> Model:
    """Fit on documents whose doc_id has a label; ``max_fit`` bounds how many, and of rows with an equal doc_id the least text serves."""
    from .language_id import bounded_sample

    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = S.materialize(bounded_sample(known, max_fit).repartition(1), "chosen")  # max_fit rows at most
    sample = S.materialize(S.texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y").repartition(parts), "sample")
    lexicon = learn_lexicon(sample, words)
    rows = _profiles(sample, lexicon, ["doc_id", "y"]).toPandas().sort_values("doc_id", kind="stable")  # max_fit rows at most
    for table in (chosen, sample):
        S.drop_table(table)
    y = rows["y"].to_numpy(float)
    if len(rows) < 2 or y.min() == y.max():
        return Model(lexicon, None, np.zeros(1), np.zeros(1), float(y.mean()) if len(rows) else 0.5)
    x = np.stack(rows["x"].to_numpy())
    fold = np.random.default_rng(7).permutation(len(x)) % 5
    raw = np.zeros(len(x))
    for k in range(5):
        if (fold == k).any():
            raw[fold == k] = boost(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon, boost(x, y), *isotonic(raw, y), 0.0)


def score(docs: DataFrame, model: Model, carry=()) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text, and the columns named in ``carry``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        t = pa.Table.from_batches([batch])
        x = np.array([profile(v.as_py() or "", shared.value.lexicon) for v in t["text"]])
        yield {"doc_id": t["doc_id"], "score": shared.value.scores(x), **{c: t[c] for c in carry}}

    return S.map_arrow(S.texts(docs, *(c for c in carry if c != "text")), work, "doc_id long, score double" + S.carried(docs, carry))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

"""Personal data: exact base patterns and a skip-chain conditional random field that adds spans.

Base spans (email, ip, card, phone) come from four patterns with checks of their digits.  The nodes of the
field are the words with a digit or an @; a word in a base span is observed.  Neighbouring nodes
are linked in a chain, and so are successive nodes that repeat or resemble each other at any distance (the
same letters and digits, or the same last seven digits or more), and each other node with an observed
look-alike.  Loopy message passing then spreads labels over a document until they settle; a word outside the base spans whose label has a probability of
``least`` or more becomes a span.

Weights are piecewise: the words' by softmax regression on shapes, the links' by the counts of label pairs,
both from base spans of a bounded sample of documents (``max_fit``, by a hash of doc_id).  Work grows with the
number of nodes and links, and both with the text.

Defined cases: null text is empty and has no span; a null doc_id is treated like any other but not learned from;
repeated rows are repeated; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# no digit run is entered in its middle, so runs of any length take linear time
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SPACES = frozenset(" \t\n\x0b\f\r")
SPACE = re.compile(r"[\x20\x09-\x0D]")
MARK = re.compile(r"[0-9@]")
#: Labels are 0 (nothing) and 1 + the number of the kind; links are of two sorts.
LABELS, CHAIN, SKIP = 1 + len(KINDS), 0, 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def marked_words(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an @, without punctuation at their ends."""
    out, end = [], 0
    m = MARK.search(text)
    while m:
        start = m.start()
        while start > end and text[start - 1] not in SPACES:
            start -= 1
        stop = SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        a, b = start, end
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a < b:
            out.append((a, b))
        m = MARK.search(text, end)
    return out


def shape(word: str) -> int:
    """Bits that describe a word, by which weights are learned."""
    digits = NOT_DIGIT.sub("", word)
    n, dots = len(digits), word.count(".")
    letters = any(c.isalpha() for c in word)
    size = 0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 8 else 4 if n < 16 else 5 if n < 20 else 6
    bits = [
        "@" in word,
        "@" in word and "." in word[word.rfind("@") :],
        dots == 3 and not letters,
        dots == 3 and not letters and all(len(p) <= 3 and int(NOT_DIGIT.sub("", p) or 999) <= 255 for p in word.split(".")),
        word[0] == "+",
        word[0] == "(" and word[-1] == ")",
        letters,
        "-" in word,
        size == 5 and luhn(digits),
        *(size == k for k in range(7)),
    ]
    return sum(int(b) << i for i, b in enumerate(bits))


BITS = 16


@dataclass
class Field:
    unary: np.ndarray  # BITS + 1 x LABELS
    pair: np.ndarray  # 2 x LABELS x LABELS


def names(word: str) -> set[tuple[str, str]]:
    """What look-alikes have in common: letters and digits, or the last seven digits or more."""
    word = word.lower()
    digits = NOT_DIGIT.sub("", word)
    out = {("w", "".join(c for c in word if c.isalnum()))}
    if len(digits) >= 7:
        out.add(("d", digits[-7:] if len(digits) < 16 else digits))
    return out


def links(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, sort): neighbours with only white space between, and each word's latest look-alikes."""
    out, last = [], {}
    for j, (a, b) in enumerate(words):
        if j and not text[words[j - 1][1] : a].strip():
            out.append((j - 1, j, CHAIN))
        own = names(text[a:b])
        for i in {last[x] for x in own if x in last}:
            out.append((i, j, SKIP))
        last.update(dict.fromkeys(own, j))
    return out


def anchors(text: str, words: list[tuple[int, int]], labels: list[int], linked: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, SKIP): each word that is not observed and its first observed look-alike of every label, before or after it, if they are not ``linked``."""
    first: dict[tuple, dict[int, int]] = {}
    for i, label in enumerate(labels):
        if label:
            for x in names(text[slice(*words[i])]):
                first.setdefault(x, {}).setdefault(label, i)
    if not first:
        return []
    known, out = {(i, j) for i, j, sort in linked if sort == SKIP}, set()
    for j, label in enumerate(labels):
        if not label:
            for x in names(text[slice(*words[j])]):
                out |= {(min(i, j), max(i, j)) for i in first.get(x, {}).values()}
    return [(i, j, SKIP) for i, j in sorted(out - known)]


def observed(words, base) -> list[int]:
    """The label of each word that overlaps a base span, else 0."""
    spans = sorted((s, e, k) for k, s, e in base)
    starts = np.array([s for s, _, _ in spans])
    longest = np.maximum.accumulate([e for _, e, _ in spans]) if spans else []
    out = []
    for a, b in words:
        label, i = 0, int(np.searchsorted(starts, b)) - 1
        while i >= 0 and longest[i] > a:
            if spans[i][1] > a:
                label = spans[i][2] + 1
                break
            i -= 1
        out.append(label)
    return out


def propagate(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, group: np.ndarray | None = None, near: float = 1e-4) -> np.ndarray:
    """Marginals by loopy belief propagation; all messages of a round at once, half damped.

    A ``group`` (the document of each node) is done when none of its messages changes by ``near`` or more; its
    rounds are bounded by 64 and twice its linked nodes, as evidence moves by one link a round.
    """

    def normal(x):
        x = x - x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    unary = unary.copy()
    group = np.zeros(len(unary), np.int64) if group is None else group
    most = 64 + 2 * np.bincount(group[np.unique(edges[:, :2])])
    to_j = np.zeros((len(edges), LABELS))
    to_i = np.zeros_like(to_j)
    rounds = 0
    while len(edges):
        nodes, ends = np.unique(edges[:, :2], return_inverse=True)
        i, j = ends.reshape(-1, 2).T
        own, w, g = unary[nodes], pair[edges[:, 2]], group[edges[:, 0]]
        stop = np.zeros(len(edges), bool)
        while not stop.any():
            rounds += 1
            b = own.copy()
            np.add.at(b, j, to_j)
            np.add.at(b, i, to_i)
            x = (b[i] - to_i)[:, :, None] + w
            y = (b[j] - to_j)[:, :, None] + w.transpose(0, 2, 1)
            new_j, new_i = (normal(np.log(np.exp(v - v.max(1, keepdims=True)).sum(1)) + v.max(1)) for v in (x, y))
            if rounds % 8 == 0:
                change = np.zeros(len(most))
                np.maximum.at(change, g, np.maximum(np.abs(new_j - to_j).max(1), np.abs(new_i - to_i).max(1)))
                stop = ((change < near) | (rounds >= most))[g]
            to_j, to_i = (to_j + new_j) / 2, (to_i + new_i) / 2
        np.add.at(unary, nodes[j[stop]], to_j[stop])
        np.add.at(unary, nodes[i[stop]], to_i[stop])
        edges, to_j, to_i = edges[~stop], to_j[~stop], to_i[~stop]
    return np.exp(normal(unary))


def _rows(batch):
    """(row, text) of the texts that have a digit or an @."""
    data, off = S.text_bytes(batch["text"])
    hit = np.zeros(256, np.int64)
    hit[48:58] = hit[64] = 1
    for lo, hi in S.pieces(off, 1 << 22):
        part = data[off[lo] : off[hi]]
        sums = np.zeros(len(part) + 1, np.int64)
        np.cumsum(hit[part], out=sums[1:])
        for r in lo + np.flatnonzero(np.diff(sums[off[lo : hi + 1] - off[lo]])):
            yield int(r), data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")


def fit(docs: DataFrame, max_fit: int = 20000) -> Field:
    from .language_id import bounded_sample

    def count(batch):
        t = pa.Table.from_batches([batch])
        seen: dict[tuple, int] = {}
        for _, text in _rows(t):
            words = marked_words(text)
            y = observed(words, base_spans(text))
            for (a, b), label in zip(words, y):
                k = (-1, shape(text[a:b]), label)
                seen[k] = seen.get(k, 0) + 1
            for i, j, sort in links(text, words):
                k = (sort, y[i], y[j])
                seen[k] = seen.get(k, 0) + 1
        if seen:
            a, b, c = zip(*seen)
            yield {"sort": a, "x": b, "y": c, "n": list(seen.values())}

    rows = bounded_sample(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), max_fit)
    got = S.map_arrow(rows, count, "sort int, x int, y int, n long").groupBy("sort", "x", "y").agg(F.sum("n").alias("n")).toPandas()  # at most 2**BITS shapes
    words = got[got["sort"] < 0].sort_values(["x", "y"])
    x = np.column_stack([np.ones(len(words)), (words["x"].to_numpy()[:, None] >> np.arange(BITS)) & 1])
    y, n = np.eye(LABELS)[words["y"].to_numpy()], words["n"].to_numpy(float)
    w = np.zeros((BITS + 1, LABELS))
    if len(words):
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 801):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - y) * n[:, None]) / n.sum() + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    pair = np.zeros((2, LABELS, LABELS))
    for sort in (CHAIN, SKIP):
        c = np.full((LABELS, LABELS), 0.5)
        own = got[got["sort"] == sort]
        np.add.at(c, (own["x"].to_numpy(), own["y"].to_numpy()), own["n"].to_numpy(float))
        c = c + c.T
        pair[sort] = np.clip(np.log(c * c.sum() / np.outer(c.sum(0), c.sum(1))), -3, 3)
    return Field(w, pair)


def find_pii(docs: DataFrame, field: Field, least: float = 0.9, redact: bool = False, carry=()) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end; code points, end exclusive) if asked for redacted_text, and the columns of ``carry``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = "doc_id long, base array<struct<kind: string, start: int, end: int>>, added array<struct<kind: string, start: int, end: int>>" + ", redacted_text string" * redact + S.carried(docs, carry)

    def work(batch):
        f = shared.value
        t = pa.Table.from_batches([batch])
        base: dict[int, list] = {}
        texts, words, node, edges = {}, [], [], []
        labels: list[int] = []
        for r, text in _rows(t):
            base[r], own = base_spans(text), marked_words(text)
            if redact:
                texts[r] = text
            seen_here, linked = observed(own, base[r]), links(text, own)
            linked += anchors(text, own, seen_here, linked)
            edges += [(len(words) + i, len(words) + j, sort) for i, j, sort in linked]
            labels += seen_here
            node += [shape(text[a:b]) for a, b in own]
            words += [(r, a, b) for a, b in own]
        added: dict[int, list] = {}
        if words:
            x = np.column_stack([np.ones(len(node)), (np.array(node)[:, None] >> np.arange(BITS)) & 1])
            unary, y = x @ f.unary, np.array(labels)
            seen = y > 0
            unary[seen] = -20.0
            unary[seen, y[seen]] = 0.0
            p = propagate(unary, np.array(edges, np.int64).reshape(-1, 3), f.pair, np.array([r for r, _, _ in words]))
            best = p.argmax(1)
            for i in np.flatnonzero(~seen & (best > 0) & (p.max(1) >= least)).tolist():
                r, a, b = words[i]
                added.setdefault(r, []).append((int(best[i]) - 1, a, b))

        def column(found):
            return [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found.get(r, ()))] for r in range(t.num_rows)]

        cols = {"doc_id": t["doc_id"], "base": column(base), "added": column(added), **{c: t[c] for c in carry}}
        if redact:
            out = t["text"].to_pylist()
            for r, text in texts.items():
                spans = sorted((a, b, k) for k, a, b in base[r] + added.get(r, []))
                parts, at = [], 0
                for a, b, k in spans:
                    if b > at:
                        if a >= at:
                            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                        at = b
                out[r] = "".join([*parts, text[at:]])
            cols["redacted_text"] = out
        yield cols

    return S.map_arrow(S.texts(docs, *carry), work, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find_pii(docs, fit(docs))

    def listed(x):
        def of(kind):
            return F.transform(F.array_sort(F.transform(F.filter(x, lambda s: s["kind"] == kind), lambda s: F.struct(s["start"], s["end"]))), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

        return F.array_join(F.concat(*(of(k) for k in KINDS)), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))

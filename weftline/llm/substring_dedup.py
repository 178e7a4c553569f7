"""Substring dedup over words by level-wise doubling.

A window is ``window`` consecutive words of one document.  A word goes if a
window that covers it also starts in a document with a smaller doc_id.

Levels.  Grams of ``first`` words come first; then, level by level, those of twice as many, and at last the
windows themselves (4, 8, 13).  A window is a candidate as long as its gram of every level so far occurs in two documents;
only the grams of candidates are extended, and the loop ends early when no candidate survives.  Two things keep
the levels small without changing a result:

* of all grams of a window its least by hash is written, and on the next level the least of those of twice the length
  that hold it and lie in the window.  Equal windows choose the same grams, so a window whose own gram
  occurs in one document alone can't repeat;
* long repeats are settled in large steps: a chunk reaches from one
  content-defined cut to the next one, plus ``window - 1`` words; if the whole chunk
  also stands in a smaller document, so do all windows that start in it, and they are no candidates any more.

Grams are compared by a 64-bit hash (a filter), windows and chunks by two independent ones.

Defined cases: null text has no words; a text shorter than a window stays; a very long text is a piece of its own; a
null doc_id stays whole and is nobody's source; rows with an equal doc_id don't
remove each other's words; repeated rows get the same result each; an empty table gives an empty table; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: One gram in so many is a cut between chunks.
CUT = 32


def levels(first: int, window: int) -> list[int]:
    """Lengths of grams: ``first``, doubled until they reach ``window``."""
    out = [max(1, first)]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    return [k for k in out if k < window] or [max(1, window - 1)]


class _Piece:
    """Words, hashes, candidates and chunks of some rows of a batch."""

    def __init__(self, data, off, lo, hi, window: int, sizes: list[int]):
        w = S.Words(data, off, lo, hi)
        h = w.hashes()
        self.one, self.two = S.Rolling(h, 11), S.Rolling(h, 12)
        self.window, self.sizes, self.first, self.n = window, sizes, w.first, hi - lo
        self.row = w.row_of()

    def windows(self) -> np.ndarray:
        """All places where a window of one row starts."""
        s = np.arange(max(0, len(self.row) - self.window + 1))
        return s[s + self.window <= self.first[self.row[s] + 1]]

    def grams(self, s: np.ndarray, level: int) -> np.ndarray:
        """The place of each window's gram of a level."""
        k = self.sizes[0]
        key = self.one.fixed(k) >> S.U64(32)
        places = (key << S.U64(32)) | np.arange(len(key), dtype=np.uint64)
        p = (S.sliding(places, self.window - k + 1, np.minimum)[s] & S.U64(0xFFFFFFFF)).astype(np.int64) if len(s) else s
        for size in self.sizes[1 : level + 1]:
            key = self.one.fixed(size) >> S.U64(32)
            low, high = np.maximum(s, p + k - size), np.minimum(p, s + self.window - size)
            p, least = low, key[low]
            for more in range(1, size - k + 1):
                q = np.minimum(low + more, high)
                better = key[q] < least
                p, least = np.where(better, q, p), np.where(better, key[q], least)
            k = size
        return p

    def chunks(self) -> None:
        grams = self.one.fixed(self.sizes[-1])
        cut = np.flatnonzero((grams & S.U64(CUT - 1)) == 0)
        row = self.row[cut]
        ok = cut + self.sizes[-1] <= self.first[row + 1]
        cut, row = cut[ok], row[ok]
        a, b, r = cut[:-1], cut[1:], row[:-1]
        ok = (row[1:] == r) & (b + self.window - 1 <= self.first[r + 1])
        self.chunk_a, self.chunk_b, self.chunk_row = a[ok], b[ok], r[ok]

    def numbered(self, row: np.ndarray, number: np.ndarray, hit: np.ndarray, hit_row: np.ndarray) -> np.ndarray:
        """Which of the things that are numbered ``number`` in their ``row`` are among the hits."""
        most = int(max(number.max(initial=0), hit.max(initial=0))) + 1
        return np.isin(row * most + number, hit_row * most + hit)


def _numbers(row: np.ndarray, n: int) -> np.ndarray:
    """Of things in the order of their rows: the number of each in its row."""
    begin = np.searchsorted(row, np.arange(n))
    return np.arange(len(row)) - begin[row]


def _runs(s: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as (begin, end) pairs, and the row of each pair's place."""
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return np.stack([s[at], s[np.append(at[1:], len(s)) - 1] + 1], 1) if len(at) else np.zeros((0, 2), np.int64), row[at]


def _first_level(window: int, sizes: list[int]):
    """Grams of the first level of all windows, and after them the chunks."""

    def work(batch):
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        for lo, hi in S.pieces(off):
            p = _Piece(data, off, lo, hi, window, sizes)
            p.chunks()
            gram = np.unique(p.grams(p.windows(), 0))
            ends = p.chunk_b + window - 1
            c1, c2 = p.one.runs(p.chunk_a, ends), p.two.runs(p.chunk_a, ends)
            row = np.concatenate([p.row[gram], p.chunk_row])
            order = np.argsort(row, kind="stable")  # of each row first its grams, then its chunks
            g1 = np.concatenate([p.one.runs(gram, gram + sizes[0]), c1])[order].view(np.int64)
            g2 = np.concatenate([np.zeros(len(gram), np.uint64), c2 | S.U64(1)])[order].view(np.int64)
            counts = np.bincount(row, minlength=p.n)
            yield {"doc_id": t["doc_id"][lo:hi], "key": t["key"][lo:hi], "g1": S.list_array(g1, counts, pa.int64()), "g2": S.list_array(g2, counts, pa.int64())}

    return work


def _flat(col, lo: int, hi: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values and row of each value of the lists in rows lo..hi."""
    c = col[lo:hi]
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    counts = np.nan_to_num(np.asarray(c.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(hi - lo), counts)


def _next_level(window: int, sizes: list[int], level: int):
    """Of rows with their candidates and hits of a level: the candidates that survive, and their grams of the next level (or they themselves)."""

    def work(batch):
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        for lo, hi in S.pieces(off):
            p = _Piece(data, off, lo, hi, window, sizes)
            hit, hit_row = _flat(t["hits"], lo, hi)
            if level == 0:
                s = p.windows()
            else:
                d, row = _flat(t["alive"], lo, hi)
                a, size, r = d[::2], d[1::2] - d[::2], row[::2]
                s = np.repeat(p.first[r] + a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            g = p.grams(s, level)
            gram, which = np.unique(g, return_inverse=True)
            number = _numbers(p.row[gram], p.n)
            s = s[p.numbered(p.row[gram], number, hit, hit_row)[which]]
            out = {"doc_id": t["doc_id"][lo:hi], "key": t["key"][lo:hi]}
            if level == 0:  # chunks are numbered after the grams
                p.chunks()
                before = np.bincount(p.row[gram], minlength=p.n)
                found = p.numbered(p.chunk_row, _numbers(p.chunk_row, p.n) + before[p.chunk_row], hit, hit_row)
                a, b, r = p.chunk_a[found], p.chunk_b[found], p.chunk_row[found]
                settled = np.zeros(len(p.row) + 1, np.int32)
                np.add.at(settled, a, 1)
                np.add.at(settled, b, -1)
                s = s[np.cumsum(settled)[s] == 0]
                out["decided"] = S.list_array(np.stack([a - p.first[r], b - p.first[r]], 1).ravel(), 2 * np.bincount(r, minlength=p.n), pa.int32())
            else:
                out["decided"] = pa.nulls(p.n, pa.list_(pa.int32()))
            runs, r = _runs(s, p.row[s])
            out["alive"] = S.list_array((runs - p.first[r][:, None]).ravel(), 2 * np.bincount(r, minlength=p.n), pa.int32())
            if level + 1 < len(sizes):
                at = np.unique(p.grams(s, level + 1))
                g1, g2 = p.one.runs(at, at + sizes[level + 1]), np.zeros(len(at), np.uint64)
            else:
                at = s
                g1, g2 = p.one.runs(at, at + window), p.two.runs(at, at + window)
            counts = np.bincount(p.row[at], minlength=p.n)
            out |= {"g1": S.list_array(g1.view(np.int64), counts, pa.int64()), "g2": S.list_array(g2.view(np.int64), counts, pa.int64())}
            yield out

    return work


def _remove(window: int, layout: str, carry=()):
    def work(batch):
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        for lo, hi in S.pieces(off):
            w = S.Words(data, off, lo, hi)
            n, first, total = hi - lo, w.first, len(w.start)
            mark = np.zeros(total + 1, np.int64)
            d, row = _flat(t["decided"], lo, hi)
            a, b, r = d[::2], d[1::2], row[::2]
            np.add.at(mark, first[r] + a, 1)
            np.add.at(mark, first[r] + b + window - 1, -1)
            d, row = _flat(t["alive"], lo, hi)
            size, r = d[1::2] - d[::2], row[::2]
            s = np.repeat(d[::2] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))  # candidates, of which the hits repeat
            r = np.repeat(r, size)
            hit, hit_row = _flat(t["hits"], lo, hi)
            begin = np.searchsorted(r, np.arange(n))
            at = begin[hit_row] + hit
            s, r = s[np.unique(at)], r[np.unique(at)]
            np.add.at(mark, first[r] + s, 1)
            np.add.at(mark, first[r] + s + window, -1)
            gone = np.cumsum(mark)[:total] > 0
            gone_sum = np.concatenate([[0], np.cumsum(gone)])
            n_removed = gone_sum[first[1:]] - gone_sum[first[:-1]]
            # bytes that stay: of a kept word, and of what stands after it
            size = len(w.data)
            keep = np.zeros(size + 1, np.int8)
            kept = np.flatnonzero(~gone)
            out = w.data
            if layout == "words":
                out = w.data.copy()
                row = w.row_of()[kept]
                last = np.ones(len(kept), bool)
                last[:-1] = row[1:] != row[:-1]
                sep = w.end[kept[~last]]  # there is a space: another word of the row follows
                out[sep] = 0x20
                np.add.at(keep, w.start[kept], 1)
                np.add.at(keep, w.end[kept] + ~last, -1)
            else:
                nxt = np.append(w.start[1:], size)
                row = w.row_of()
                nxt = np.minimum(nxt, w.row_off[row + 1])
                np.add.at(keep, w.start[kept], 1)
                np.add.at(keep, nxt[kept], -1)
                lead = np.minimum(np.append(w.start, size)[first[:-1]], w.row_off[1:])  # what stands before a row's first word
                ok = lead > w.row_off[:-1]
                np.add.at(keep, w.row_off[:-1][ok], 1)
                np.add.at(keep, lead[ok], -1)
            mask = np.cumsum(keep[:size], dtype=np.int8) > 0
            sums = np.zeros(size + 1, np.int64)
            np.cumsum(mask, out=sums[1:])
            kept_off = sums[w.row_off]
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept_off), pa.py_buffer(np.ascontiguousarray(out[mask]))])
            # maximal runs of removed words
            edge = np.zeros(total + 1, bool)
            edge[first[:-1][first[:-1] < total]] = True
            prev = np.concatenate([[False], gone[:-1]]) & ~edge[:total]
            begin = np.flatnonzero(gone & ~prev)
            follow = np.concatenate([gone[1:], [False]]) & ~edge[1:] if total else gone
            finish = np.flatnonzero(gone & ~follow) + 1
            r = np.searchsorted(first, begin, side="right") - 1
            spans = np.stack([begin - first[r], finish - first[r]], 1).ravel()
            yield {
                "doc_id": t["doc_id"][lo:hi],
                "n_words": w.counts.astype(np.int64),
                "n_removed": n_removed.astype(np.int64),
                "removed_spans": S.list_array(spans, 2 * np.bincount(r, minlength=n), pa.int32()),
                "kept_text": text.cast(pa.large_string()),
                **{c: t[c][lo:hi] for c in carry},
            }

    return work


GRAMS = "doc_id long, key long, g1 array<long>, g2 array<long>"
STATE = "doc_id long, key long, decided array<int>, alive array<int>, g1 array<long>, g2 array<long>"


def _repeated(grams: DataFrame, source_too) -> DataFrame:
    """doc_id, key, hits: numbers of the grams that occur in two documents; where not ``source_too``, only in those after the first."""
    flat = grams.select("doc_id", "key", F.posexplode(F.arrays_zip("g1", "g2")).alias("at", "g")).select("doc_id", "key", "at", F.col("g.g1").alias("h1"), F.col("g.g2").alias("h2"))
    again = S.materialize(flat.groupBy("h1", "h2").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("h1", "h2", "d0"), "repeated")
    found = flat.join(again, ["h1", "h2"]).where(source_too | (F.col("d0") < F.col("doc_id")))
    hits = S.materialize(found.groupBy("doc_id", "key").agg(F.collect_list("at").alias("hits")), "hits")
    S.drop_table(again)
    return hits


def removed_windows(docs: DataFrame, window: int = 13, first: int = 4) -> DataFrame:
    """doc_id, key (hash of the text), decided (begin, end, ... of window starts that chunks settle) and pos (begin, end, ... of other window starts that repeat)."""
    sizes = levels(first, window)
    t = S.texts(docs).withColumn("key", F.xxhash64("text"))
    state = S.materialize(S.map_arrow(t.where("doc_id is not null and text is not null"), _first_level(window, sizes), GRAMS), "grams")
    hits, decided = _repeated(state, F.col("h2") == 0), None
    for level in range(len(sizes)):
        rows = t.join(hits, ["doc_id", "key"])
        if level:
            # repeated rows have equal states, so any of them will do
            rows = rows.join(state.groupBy("doc_id", "key").agg(F.first("alive").alias("alive")), ["doc_id", "key"])
        last = level + 1 == len(sizes)
        state = S.materialize(S.map_arrow(rows.select("doc_id", "key", "text", "hits", *(["alive"] if level else [])), _next_level(window, sizes, level), STATE), "windows" if last else "grams")
        decided = state if decided is None else decided
        S.drop_table(hits)
        hits = _repeated(state, F.lit(not last))
        if hits.isEmpty():  # no candidate survives
            break
    alive = state.groupBy("doc_id", "key").agg(F.first("alive").alias("alive"))
    settled = decided.where(F.size("decided") > 0).groupBy("doc_id", "key").agg(F.first("decided").alias("decided"))
    found = hits.join(alive, ["doc_id", "key"])
    return S.materialize(settled.join(found, ["doc_id", "key"], "full"), "removed")


def substring_dedup(docs: DataFrame, window: int = 13, first: int = 4, layout: str = "original", carry=()) -> DataFrame:
    """doc_id, n_words, n_removed, removed_spans (word numbers: begin, end, ...), kept_text.

    ``layout``: "original" keeps the white space after each kept word, "words" joins the kept words by one space.
    The columns of ``carry`` pass through.
    """
    removed = removed_windows(docs, window, first)
    t = S.texts(docs, *carry).withColumn("key", F.xxhash64("text")).join(removed, ["doc_id", "key"], "left")
    return S.map_arrow(t.select("doc_id", "text", "decided", "alive", "hits", *carry), _remove(window, layout, carry), "doc_id long, n_words long, n_removed long, removed_spans array<int>, kept_text string" + S.carried(docs, carry))


def op3(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), layout="words")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: all windows spelled out as lists of words; fit for small tables.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS s, words FROM w WHERE len(words) >= 13),
named AS (SELECT doc_id, s, md5_number(array_to_string(words[s : s + 12], ' ')) AS k FROM win),
least AS (SELECT k, min(doc_id) AS d0 FROM named GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, list(s) AS ss FROM named JOIN least USING (k) WHERE d0 < doc_id GROUP BY doc_id),
cover AS (SELECT doc_id, list_distinct(flatten(list_transform(ss, lambda x: range(x, x + 13)))) AS gone FROM hit),
kept AS (
  SELECT w.doc_id, len(words) AS n, coalesce(len(gone), 0) AS r,
         CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM kept
"""

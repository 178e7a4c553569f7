"""Exact substring dedup over bytes by a sparse suffix array that is sorted in buckets.

A byte goes if a string of ``window`` bytes that covers it also starts in a document with a smaller
doc_id.  The strings are the suffixes' first ``window`` bytes.  Most suffixes can't repeat, or
lie inside long repeats, so two rounds leave few to sort:

* a round takes content-defined anchors (see :func:`shared.anchors`), first of 16 bytes, then of 32; a suffix
  whose own anchor occurs in one document alone is dropped;
* the same round settles chunks between content-defined cuts, first far apart, then close: a chunk with the
  ``window - 1`` bytes after it that also stands in a smaller document settles all suffixes that start in it, and
  where its source has suffixes that nobody holds without the chunk, they are dropped.

The texts are written in blocks of about ``BLOCK_BYTES``, dealt by their number once, so that no round shuffles them again.  A block asks for each of its hashes once, with its least
document and its count, so a hash that all documents have costs one entry a block.  The questions of a block to one part of
the hashes, and the answers, are packed in one binary value; numpy sorts them.

The suffixes that are left are range-partitioned by their leading tokens (eight bytes each, as numbers in byte order, then
doc_id, so that no bucket holds more than its share of a frequent string) at sampled splitters.  Each bucket
sorts its suffixes by multikey quicksort and compares neighbours; a run of equal suffixes that goes on from the bucket
before takes its least document from there.  The driver sees ``SAMPLES`` suffixes a bucket, to choose the splitters.

What the second round asks and what is left to sort are written in up to ``PASSES`` ranges, and one range after the other is
shuffled, so the disk holds the shuffle of one range only.  A block packs its suffixes by range; a task of a range's shuffle packs
those of many blocks by bucket, so that packed values stay large however many buckets there are.

Anchors are compared by a 64-bit hash (a filter), chunks by two, suffixes by their bytes.

Defined cases: null text is empty; a text shorter than the window stays; a null doc_id stays whole and is nobody's
source; rows with an equal doc_id don't remove each other's bytes; an empty table gives an empty table; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Of each round: bytes of an anchor, and one place in so many is a cut.
ROUNDS = ((16, 128), (32, 8))
BLOCK_BYTES, PART_BYTES = 1 << 22, 1 << 24
#: Bytes that numpy works on at once: the arrays of a piece fit in a core's cache.
PIECE_BYTES = 1 << 17
BUCKET_ROWS, SAMPLES, SAMPLED = 250_000, 64, 1 / 256
#: Ranges that are shuffled one after the other, one for so many bytes of text; suffixes that a task packs at once.
PASSES, PASS_BYTES, DEALT_ROWS = 8, 1 << 28, 1 << 19

# columns of packed values
ASKED = ("<u8", "<u8", "<i8", "<u4", "u1")  # both hashes, least document, how often, whether in several documents
FOUND = ("<u8", "<u8", "<i8", "<i8")  # both hashes, least document and how often, over all blocks
SETTLED = ("<i8", "<i8", "<i8")  # row of the block, begin, end
PLACES = ("<u4", "<u4")  # row of the block, place
LEFT_AT, DEALT_AT = ("<i8", "<u4", "<u4"), ("<i8", "<i8", "<u4", "<u4")  # of a suffix: document, row, place; document, block, row, place
NONE = np.zeros(0, np.int64)


def _pack(*columns) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(values, kinds) -> list[np.ndarray]:
    """The columns of all packed values, one after the other."""
    width, out = sum(np.dtype(k).itemsize for k in kinds), [[np.zeros(0, k)] for k in kinds]
    for v in values:
        at, n = 0, len(v) // width
        for k, to in zip(kinds, out):
            to.append(np.frombuffer(v, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in out]


def _values(t: pa.Table, name: str) -> list:
    return [x.as_buffer() for c in t[name].chunks for x in c]


def _runs(h1, h2) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs of hashes together, and where each run of them begins."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    if (same & other).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), ~same]))


def _lookup(found, h1, h2) -> np.ndarray:
    """Where each pair of hashes stands in the sorted pairs of ``found``, or -1."""
    at, out, left = np.searchsorted(found[0], h1), np.full(len(h1), -1), np.arange(len(h1))
    while len(left):
        left = left[at[left] < len(found[0])]
        left = left[found[0][at[left]] == h1[left]]
        hit = found[1][at[left]] == h2[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
    return out


class _Bytes:
    """Rolling hashes of the texts of some rows of a batch."""

    def __init__(self, data, off, lo, hi, doc, window: int):
        self.data, self.first, self.window = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], window
        self.total = int(off[hi] - off[lo])
        self.doc, self.valid = doc[0][lo:hi], doc[1][lo:hi]
        self.one = S.Rolling(S._byte_values(3, False)[self.data], 3)
        self._two, self._fixed = None, {}

    def two(self, a, b):
        self._two = self._two or S.Rolling(S._byte_values(4, False)[self.data], 4)
        return self._two.runs(a, b)

    def fixed(self, k: int):
        if k not in self._fixed:
            self._fixed[k] = self.one.fixed(k)
        return self._fixed[k]

    def row(self, at):
        return np.searchsorted(self.first, at, side="right") - 1

    def whole(self) -> np.ndarray:
        """Which places begin a window inside their row; a row without doc_id has none."""
        out = np.zeros(self.total + 1, np.int32)
        size = np.maximum(np.diff(self.first) - self.window + 1, 0) * self.valid
        np.add.at(out, self.first[:-1], (size > 0).astype(np.int32))
        np.add.at(out, self.first[:-1] + size, -(size > 0).astype(np.int32))
        return np.cumsum(out)[: self.total] > 0

    def grams(self, level: int, alive: np.ndarray):
        """Anchors and chunks of a round for the windows that are alive."""
        k, cut_one = ROUNDS[level]
        h = self.fixed(k)
        w = self.window - k + 1
        self.key = (h >> S.U64(32)).astype(np.uint32)
        self.width = w
        self.anchor = S.anchors(h, self.first, k, self.window, alive[: max(0, len(h) - w + 1)])
        self.anchor_hash = (h[self.anchor] << S.U64(32)) | (h[self.anchor] >> S.U64(32))  # an anchor's high bits are small
        self.anchor_row = self.row(self.anchor)
        g = self.fixed(16)
        cut = np.flatnonzero((g & S.U64(cut_one - 1)) == 0)
        r = self.row(cut)
        ok = cut + 16 <= self.first[r + 1]
        cut, r = cut[ok], r[ok]
        a, b, r0 = cut[:-1], cut[1:], r[:-1]
        sums = np.concatenate([[0], np.cumsum(alive)])
        ok = (r[1:] == r0) & (b + self.window - 1 <= self.first[r0 + 1])
        ok &= sums[b] - sums[a] == b - a
        self.chunk_a, self.chunk_b, self.chunk_row = a[ok], b[ok], r0[ok]
        ends = self.chunk_b + self.window - 1
        self.chunk_one, self.chunk_two = self.one.runs(self.chunk_a, ends), self.two(self.chunk_a, ends) | S.U64(1)

    def asked(self):
        """Both hashes and the document of the anchors and chunks."""
        h1 = np.concatenate([self.anchor_hash, self.chunk_one])
        h2 = np.concatenate([np.zeros(len(self.anchor), np.uint64), self.chunk_two])
        return h1, h2, self.doc[np.concatenate([self.anchor_row, self.chunk_row])]

    def apply(self, found):
        """What the hashes that several documents have leave alive, and the chunks that they settle.

        Where a document is the source of a chunk, a window inside is alive only if its own anchor occurs more
        often than the chunk: else nobody has that window without having, and being settled by, the chunk.
        """
        a = _lookup(found, self.anchor_hash, np.zeros(len(self.anchor), np.uint64))
        number = np.flatnonzero(a >= 0)
        some = np.full(len(self.key), 0xFFFFFFFF, np.uint32)
        some[self.anchor[number]] = self.key[self.anchor[number]]
        own = np.zeros(self.total, bool)
        if len(self.key) >= self.width:
            got = S.sliding(some, self.width, np.minimum) == S.sliding(self.key, self.width, np.minimum)
            own[: len(got)] = got
        c = _lookup(found, self.chunk_one, self.chunk_two)
        held = np.flatnonzero(c >= 0)
        first = found[2][c[held]] == self.doc[self.chunk_row[held]]
        chunk, source = held[~first], held[first]
        if len(source):
            inside = np.zeros(self.total, np.int64)  # how often the chunk around a place occurs
            count_of = np.zeros(len(self.chunk_a), np.int64)
            count_of[held] = found[3][c[held]]
            size = self.chunk_b[source] - self.chunk_a[source]
            at = np.repeat(self.chunk_a[source] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            inside[at] = np.repeat(count_of[source], size)
            often = np.zeros(len(self.key), np.int64)
            often[self.anchor[number]] = found[3][a[number]]
            # a window's own anchor: the place nearest to its start that has its least key
            least = S.sliding(self.key, self.width, np.minimum)
            chosen = np.zeros(len(self.key), bool)
            chosen[self.anchor] = True
            last = np.where(chosen, np.arange(len(self.key)), len(self.key))
            follows = np.minimum.accumulate(last[::-1])[::-1]  # next anchor at or after a place
            w = np.flatnonzero((inside[: len(least)] > 0) & own[: len(least)])
            near = follows[w]
            todo = np.ones(len(w), bool)
            for _ in range(8):  # few anchors stand before a window's own one
                wrong = todo & (near < len(self.key))
                wrong[wrong] = self.key[near[wrong]] != least[w[wrong]]
                if not wrong.any():
                    break
                near[wrong] = follows[np.minimum(near[wrong] + 1, len(self.key) - 1)]
            ok = (near < np.minimum(w + self.width, len(self.key))) & (self.key[np.minimum(near, len(self.key) - 1)] == least[w])
            ok[ok] = often[near[ok]] == inside[w[ok]]
            own[w[ok]] = False
        return own, self.chunk_a[chunk], self.chunk_b[chunk], self.chunk_row[chunk]

    def settled(self, a, b) -> np.ndarray:
        out = np.zeros(self.total + 1, np.int32)
        np.add.at(out, a, 1)
        np.add.at(out, b, -1)
        return np.cumsum(out)[: self.total] > 0


def _in_blocks(batches):
    """Rows of a task to blocks of about BLOCK_BYTES, each one compressed value; a longer text may fill one alone."""
    from pyspark import TaskContext

    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block():
        doc, length, valid, data = (np.concatenate(x) for x in zip(*held))
        raw = _pack(doc, length, valid, data)
        value = _pack(np.array([len(raw), len(doc)])) + pa.compress(raw, "zstd", asbytes=True)
        return _table([((task << 33) + number, size, value)], ["block", "size", "texts"], [pa.int64(), pa.int64(), pa.binary()]).to_batches()

    for batch in batches:
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        doc = t["doc_id"].combine_chunks()
        valid, doc = doc.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)
        for lo, hi in S.pieces(off, BLOCK_BYTES // 8):
            if held and size + off[hi] - off[lo] > BLOCK_BYTES:
                yield from block()
                number, held, size = number + 1, [], 0
            held.append((doc[lo:hi], np.diff(off[lo : hi + 1]), valid[lo:hi].astype(np.uint8), data[off[lo] : off[hi]]))
            size += int(off[hi] - off[lo])
    if held:
        yield from block()


def _block_of(value):
    """Bytes, offsets, documents and which rows have one, of a value of :func:`_in_blocks`."""
    size, n = np.frombuffer(value, np.int64, 2).tolist()
    raw = pa.decompress(memoryview(value)[16:], decompressed_size=size, codec="zstd")
    doc, length = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n)
    valid = np.frombuffer(raw, np.uint8, n, 16 * n) > 0
    return np.frombuffer(raw, np.uint8, offset=17 * n) if size > 17 * n else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(length)]), (doc, valid)


def _questions(block: int, asked: list, parts: int):
    """Rows of part, block and packed value: each hash of the block once."""
    h1, h2, doc = (np.concatenate(x) for x in zip(*asked))
    order, begin = _runs(h1, h2)
    if not len(begin):
        return
    h1, h2, doc = h1[order][begin], h2[order][begin], doc[order]
    least, most = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
    n = np.diff(np.append(begin, len(doc))).astype(np.uint32)
    part = ((h1 >> S.U64(32)) * S.U64(parts)) >> S.U64(32)  # rises with h1
    cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    for lo, hi in zip(cut[:-1], cut[1:]):
        yield int(part[lo]), block, _pack(h1[lo:hi], h2[lo:hi], least[lo:hi], n[lo:hi], (least < most)[lo:hi])


def _table(rows: list, names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


SENT, SENT_NAMES, SENT_KINDS = "part long, block long, blob binary, settled binary", ["part", "block", "blob", "settled"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _round_one(window: int, parts: int):
    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for block, value in zip(t["block"].to_pylist(), _values(t, "texts")):
                (data, off, doc), asked = _block_of(value), []
                for lo, hi in S.pieces(off, PIECE_BYTES):
                    b = _Bytes(data, off, lo, hi, doc, window)
                    b.grams(0, b.whole())
                    asked.append(b.asked())
                yield from _table([(*q, None) for q in _questions(block, asked, parts)], SENT_NAMES, SENT_KINDS).to_batches()

    return run


def _answers(batches):
    """To each block that asked: its hashes that several documents have."""
    for t, cut in S.whole_groups(batches, ["part"]):
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            values, block = _values(t[lo:hi], "blob"), t["block"][lo:hi].to_pylist()
            width = sum(np.dtype(k).itemsize for k in ASKED)
            by = np.repeat(np.arange(hi - lo), [len(v) // width for v in values])
            h1, h2, doc, n, several = _unpack(values, ASKED)
            order, begin = _runs(h1, h2)
            if not len(begin):
                continue
            least, most = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
            total = np.add.reduceat(n[order].astype(np.int64), begin)
            again = (least < most) | (np.maximum.reduceat(several[order], begin) > 0)
            run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
            order, run = order[again[run]], run[again[run]]
            back = np.argsort(by[order], kind="stable")
            order, run = order[back], run[back]
            edge = np.searchsorted(by[order], np.arange(hi - lo + 1))
            rows = []
            for i in np.flatnonzero(edge[1:] > edge[:-1]):
                o, r = order[edge[i] : edge[i + 1]], run[edge[i] : edge[i + 1]]
                rows.append((block[i], _pack(h1[o], h2[o], least[r], total[r]), int((h2[o] == 0).sum())))
            yield from _table(rows, ["block", "blob", "anchors"], [pa.int64(), pa.binary(), pa.int64()]).to_batches()


def _found(values):
    f = _unpack(values, FOUND)
    order = np.lexsort((f[1], f[0]))
    return [x[order] for x in f]


def _strings(b: _Bytes, at, window: int) -> np.ndarray:
    """The first bytes of the suffixes at some places."""
    return np.lib.stride_tricks.sliding_window_view(b.data, window)[at] if len(at) else np.zeros((0, window), np.uint8)


def _tokens(strings: np.ndarray) -> list[np.ndarray]:
    """Strings as numbers of eight bytes each, in byte order."""
    n, window = strings.shape
    raw = np.zeros((n, -(-window // 8) * 8), np.uint8)
    raw[:, :window] = strings
    return list(raw.view(">u8").astype(np.uint64).T)


def _pack_suffixes(strings, *columns) -> bytes:
    return _pack(np.array([len(strings)])) + pa.compress(_pack(strings, *columns), "zstd", asbytes=True)


def _unpack_suffixes(values, window: int, kinds):
    """Strings, the columns beside them and how many each value has, of all packed suffixes."""
    width, size, strings, packed = window + sum(np.dtype(k).itemsize for k in kinds), [], [], []
    for v in values:
        n = int(np.frombuffer(v, np.int64, 1)[0])
        raw = pa.decompress(memoryview(v)[8:], decompressed_size=n * width, codec="zstd")
        strings.append(np.frombuffer(raw, np.uint8, n * window).reshape(n, window))
        packed.append(memoryview(raw)[n * window :])
        size.append(n)
    return np.concatenate(strings), _unpack(packed, kinds), size


def _thinned(words: int, share: float):
    kinds = ("<u8",) * words + ("<i8",)

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            columns = _unpack(_values(t, "blob"), kinds)
            some = np.random.default_rng(len(columns[0])).random(len(columns[0])) < share
            yield from _table([(_pack(*(c[some] for c in columns)),)], ["blob"], [pa.binary()]).to_batches()

    return run


def splitters(sample: list[np.ndarray], buckets: int) -> list[np.ndarray]:
    """Of sampled rows (their columns, the most important first): the rows at the edges of equal shares."""
    order = np.lexsort(sample[::-1])
    at = np.unique(np.arange(1, buckets) * len(order) // buckets)
    return [c[order[at]] if len(order) else c[:0] for c in sample]


def bucket_of(columns: list[np.ndarray], split: list[np.ndarray]) -> np.ndarray:
    """How many splitters are not above each row, by all columns."""
    lo, hi = np.searchsorted(split[0], columns[0], "left"), np.searchsorted(split[0], columns[0], "right")
    open_ = np.flatnonzero(lo < hi)  # the first columns are equal: halve by all of them
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        above, tied = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for c, s in zip(columns, split):
            above |= tied & (s[mid] > c[open_])
            tied &= s[mid] == c[open_]
        hi[open_] = np.where(above, mid, hi[open_])
        lo[open_] = np.where(above, lo[open_], mid + 1)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _round_two(window: int, parts: int):
    """Questions of the second round; under part -1 what is alive and settled after the first, under -2 a sample of what is alive."""

    def work(rows: pa.Table, hits: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and hits.num_rows:
            block = rows["block"][0].as_py()
            data, off, doc = _block_of(_values(rows, "texts")[0])
            found, asked, alive, settled, sample = _found(_values(hits, "blob")), [], np.zeros(len(data), bool), [], []
            chance = np.random.default_rng(block)
            for lo, hi in S.pieces(off, PIECE_BYTES):
                b = _Bytes(data, off, lo, hi, doc, window)
                whole = b.whole()
                b.grams(0, whole)
                own, *chunks = b.apply(found)
                left = whole & own & ~b.settled(*chunks[:2])
                alive[off[lo] : off[hi]] = left
                settled.append(_absolute(b, lo, *chunks))
                some = np.flatnonzero(left)
                some = some[chance.random(len(some)) < SAMPLED]
                sample.append((*_tokens(_strings(b, some, window)), b.doc[b.row(some)]))
                b.grams(1, left)
                asked.append(b.asked())
            out = [(*q, None) for q in _questions(block, asked, parts)]
            out.append((-1, block, np.packbits(alive).tobytes(), _pack(*(np.concatenate(x) for x in zip(*settled)))))
            out.append((-2, block, _pack(*(np.concatenate(x) for x in zip(*sample))), None))
        return _table(out, SENT_NAMES, SENT_KINDS)

    return work


def _absolute(b: _Bytes, lo: int, begin, end, row):
    """Row of the block, begin and end in it, of settled places."""
    return row + lo, begin - b.first[row], end - b.first[row]


LEFT_NAMES, LEFT_KINDS = ["pass", *SENT_NAMES[1:]], SENT_KINDS
LEFT = "pass long, block long, blob binary, settled binary"


def _by_number(columns: list[np.ndarray], number: np.ndarray):
    """Each number with its rows of all columns."""
    order = np.argsort(number, kind="stable")
    for o in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else ():
        yield int(number[o[0]]), [c[o] for c in columns]


def _round_three(window: int, split: list[np.ndarray], each: int):
    """The suffixes to sort, by pass (``each`` buckets make one), and in pass -1 all that is settled."""

    def work(rows: pa.Table, more: pa.Table) -> pa.Table:
        state = more.filter(pc.equal(more["part"], -1))
        if not rows.num_rows or not state.num_rows:
            return _table([], LEFT_NAMES, LEFT_KINDS)
        block = rows["block"][0].as_py()
        data, off, doc = _block_of(_values(rows, "texts")[0])
        found = _found(_values(more.filter(pc.not_equal(more["part"], -1)), "blob"))
        alive = np.unpackbits(np.frombuffer(_values(state, "blob")[0], np.uint8), count=len(data)).astype(bool)
        settled, left = [tuple(_unpack(_values(state, "settled"), SETTLED))], []
        for lo, hi in S.pieces(off, PIECE_BYTES):
            live = alive[off[lo] : off[hi]]
            if not live.any():
                continue
            b = _Bytes(data, off, lo, hi, doc, window)
            b.grams(1, live)
            own, *chunks = b.apply(found)
            settled.append(_absolute(b, lo, *chunks))
            at = np.flatnonzero(live & own & ~b.settled(*chunks[:2]))
            row = b.row(at)
            left.append((_strings(b, at, window), b.doc[row], (row + lo).astype(np.uint32), (at - b.first[row]).astype(np.uint32)))
        out = [(-1, block, None, _pack(*(np.concatenate(x) for x in zip(*settled))))]
        if left:
            columns = [np.concatenate(x) for x in zip(*left)]
            bucket = bucket_of([*_tokens(columns[0]), columns[1]], split)
            out += [(i, block, _pack_suffixes(*own), None) for i, own in _by_number(columns, bucket // each)]
        return _table(out, LEFT_NAMES, LEFT_KINDS)

    return work


def _dealt(window: int, split: list[np.ndarray]):
    """The suffixes of some blocks of one pass by bucket, each with its block."""

    def packed(values, blocks):
        strings, (doc, row, pos), size = _unpack_suffixes(values, window, LEFT_AT)
        columns = [strings, doc, np.repeat(np.array(blocks, np.int64), size), row, pos]
        rows = [(i, _pack_suffixes(*own)) for i, own in _by_number(columns, bucket_of([*_tokens(strings), doc], split))]
        return _table(rows, ["bucket", "blob"], [pa.int64(), pa.binary()]).to_batches()

    def run(batches):
        values, blocks, n = [], [], 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for block, value in zip(t["block"].to_pylist(), _values(t, "blob")):
                values.append(value)
                blocks.append(block)
                n += int(np.frombuffer(value, np.int64, 1)[0])
                if n >= DEALT_ROWS:
                    yield from packed(values, blocks)
                    values, blocks, n = [], [], 0
        if values:
            yield from packed(values, blocks)

    return run


def multikey_quicksort(columns: list[np.ndarray], cutoff: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by all columns, and which differ from the row before.

    Rows are split in three by a pivot of the first column: the lower and the higher ones are split again by that
    column, the equal ones by the next.  What is left of up to ``cutoff`` rows is sorted at once.
    """
    n = len(columns[0])
    order, new = np.arange(n), np.zeros(n, bool)
    todo = [(0, n, 0)] if n else []
    while todo:
        lo, hi, depth = todo.pop()
        new[lo] = True
        part = order[lo:hi]
        if hi - lo == 1 or depth == len(columns):
            continue
        if hi - lo <= cutoff:
            o, fresh = _sorted_runs([c[part] for c in columns[depth:]])
            order[lo:hi], new[lo:hi] = part[o], fresh
            continue
        v = columns[depth][part]
        some = v[:: max(1, len(v) // 64)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        low, high = v < pivot, v > pivot
        a, z = lo + int(low.sum()), hi - int(high.sum())
        order[lo:hi] = np.concatenate([part[low], part[~(low | high)], part[high]])
        todo += [x for x in ((lo, a, depth), (a, z, depth + 1), (z, hi, depth)) if x[0] < x[1]]
    return order, new


def _sorted_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same for few rows: runs of equals go on to the next column."""
    n = len(columns[0])
    order = np.argsort(columns[0], kind="stable")
    v = columns[0][order]
    new = np.ones(n, bool)
    new[1:] = v[1:] != v[:-1]
    for c in columns[1:]:
        run = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(tied):
            break
        sub = order[tied]
        o = np.lexsort((c[sub], run[tied]))
        order[tied] = sub[o]
        v, r = c[sub[o]], run[tied]
        more = np.zeros(len(tied), bool)
        more[1:] = (v[1:] != v[:-1]) & (r[1:] == r[:-1])
        new[tied] |= more
    return order, new


BUCKET = "block long, bucket long, places binary, least long, first binary, last binary, last_least long"
BUCKET_NAMES = [x.split()[0] for x in BUCKET.split(", ")]
BUCKET_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]


def _sort_bucket(window: int):
    """Of each bucket: the places of each block that go.

    The first run may begin in a bucket before, so its least document's places come with ``bucket`` and ``least``; one
    more row, without places, tells the bucket's first and last run.
    """

    def run(batches):
        for t, cut in S.whole_groups(batches, ["bucket"]):
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                bucket = t["bucket"][lo].as_py()
                strings, (doc, block, row, pos), _ = _unpack_suffixes(_values(t[lo:hi], "blob"), window, DEALT_AT)
                tokens = _tokens(strings)
                block, by = np.unique(block, return_inverse=True)
                order, new = multikey_quicksort(tokens)
                run_of = np.cumsum(new) - 1
                least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
                gone = least[run_of] < doc[order]
                rows = []
                for which, number in ((gone, None), (~gone & (run_of == 0), bucket)):
                    o = order[which]
                    o = o[np.argsort(by[o], kind="stable")]
                    edge = np.searchsorted(by[o], np.arange(len(block) + 1))
                    for i in np.flatnonzero(edge[1:] > edge[:-1]):
                        p = o[edge[i] : edge[i + 1]]
                        rows.append((int(block[i]), number, _pack(row[p], pos[p]), int(least[0]), None, None, None))
                first, last = (_pack(*(c[order[i]] for c in tokens)) for i in (0, -1))
                rows.append((None, bucket, None, int(least[0]), first, last, int(least[-1])))
                yield from _table(rows, BUCKET_NAMES, BUCKET_KINDS).to_batches()

    return run


def _repeated(sent: DataFrame, parts: int) -> DataFrame:
    return S.materialize(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answers, "block long, blob binary, anchors long"), "hits")


def _parts(spark, least: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def text_blocks(docs: DataFrame) -> DataFrame:
    """block, size (bytes of text) and texts (compressed, with the documents) of all rows, dealt by block."""
    S.ship(docs.sparkSession)
    rows = S.materialize(S.texts(docs).mapInArrow(_in_blocks, "block long, size long, texts binary"), "texts")
    out = S.bucketed(rows, "block", _parts(docs.sparkSession, -(-_size(rows) // PART_BYTES)), "blocks")
    S.drop_table(rows)
    return out


def _size(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("size")).first()[0] or 0


def repeated_suffixes(blocks: DataFrame, window: int = 50) -> DataFrame:
    """block, settled (runs of places, packed) and places (single ones, packed) where strings of a smaller document start."""
    words = -(-window // 8)
    if window < max(k for k, _ in ROUNDS) + 2:
        raise ValueError("window is too short for the anchors")
    spark, size = blocks.sparkSession, _size(blocks)
    parts, passes = _parts(spark, -(-size // PART_BYTES)), max(1, min(PASSES, -(-size // PASS_BYTES)))
    texts = blocks.select("block", "texts")
    hits = _repeated(texts.mapInArrow(_round_one(window, parts), SENT).select("part", "block", "blob"), parts)
    two = texts.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(_round_two(window, parts), SENT)
    step = -(-parts // passes)
    two = S.materialize(two.withColumn("pass", F.when(F.col("part") < 0, F.col("part")).otherwise(F.floor(F.col("part") / step))), "asked", "pass")
    S.drop_table(hits)
    kinds = ("<u8",) * words + ("<i8",)
    sample = S.materialize(two.where("pass = -2").select("blob"), "sample")
    n = (sample.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) // sum(np.dtype(k).itemsize for k in kinds)
    state = S.materialize(two.where("pass = -1").select(*SENT_NAMES), "state")
    found = [_repeated(two.where(F.col("pass") == i).select("part", "block", "blob"), step) for i in range(passes)]
    S.drop_table(two)
    hits = reduce(DataFrame.unionAll, found)
    # an anchor that repeats leaves about so many suffixes; the splitters are of all that the first round left
    each = (window - ROUNDS[1][0] + 2) // 2
    buckets = _parts(spark, -(-(hits.agg(F.sum("anchors")).first()[0] or 0) * each // BUCKET_ROWS))
    thin = sample.mapInArrow(_thinned(words, min(1.0, SAMPLES * buckets / max(1, n))), "blob binary")
    split = splitters(_unpack([bytes(r.blob) for r in thin.collect()], kinds), buckets)
    S.drop_table(sample)
    more = state.unionAll(hits.select(F.lit(0).cast("long"), "block", "blob", F.lit(None).cast("binary")))
    step = -(-buckets // passes)
    three = S.materialize(texts.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(_round_three(window, split, step), LEFT), "suffixes", "pass")
    for t in (*found, state):
        S.drop_table(t)
    settled = S.materialize(three.where("pass = -1").select("block", "settled"), "settled")
    sorted_ = []
    for i in range(passes):
        ordered = three.where(F.col("pass") == i).select("block", "blob").mapInArrow(_dealt(window, split), "bucket long, blob binary").repartition(step, "bucket").sortWithinPartitions("bucket")
        sorted_.append(S.materialize(ordered.mapInArrow(_sort_bucket(window), BUCKET), "buckets"))
    S.drop_table(three)
    sorted_ = reduce(DataFrame.unionAll, sorted_)
    # across boundaries: a bucket's first run goes on from those whose last run is of the same string
    edges = sorted_.where("block is null")
    ends = edges.groupBy(F.col("last").alias("first")).agg(F.min("last_least").alias("before"))
    ends = edges.select("bucket", "first").join(ends, "first").select("bucket", "before")
    rows = sorted_.where("block is not null")
    first = rows.where("bucket is not null").join(ends, "bucket").where("before < least")
    found = rows.where("bucket is null").select("block", "places").unionAll(first.select("block", "places"))
    nothing = F.lit(None).cast("binary")
    return found.select("block", nothing.alias("settled"), "places").unionAll(settled.select("block", "settled", nothing))


def _cut(window: int):
    def work(rows: pa.Table, removed: pa.Table) -> pa.Table:
        data, off, (doc, valid) = _block_of(_values(rows, "texts")[0])
        n, total = len(off) - 1, len(data)
        mark = np.zeros(total + 1, np.int32)
        row, begin, end = _unpack(_values(removed.filter(removed["settled"].is_valid()), "settled"), SETTLED)
        np.add.at(mark, off[row] + begin, 1)
        np.add.at(mark, off[row] + end + window - 1, -1)
        row, pos = _unpack(_values(removed.filter(removed["places"].is_valid()), "places"), PLACES)
        np.add.at(mark, off[row] + pos, 1)
        np.add.at(mark, off[row] + pos + window, -1)
        gone = np.cumsum(mark)[:total] > 0
        before = np.zeros(total, bool)
        before[1:] = gone[:-1]
        before[off[:-1][off[:-1] < total]] = False
        spans, away = (np.concatenate([[0], np.cumsum(x)]) for x in (gone & ~before, gone))
        kept = np.concatenate([[0], np.cumsum(~gone)])[off]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        columns = [pa.array(doc, mask=~valid), pa.array(np.diff(off)), pa.array(np.diff(away[off])), pa.array(np.diff(spans[off])), raw.cast(pa.binary())]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return work


def suffix_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every row."""
    blocks = text_blocks(docs)
    removed = repeated_suffixes(blocks, window)
    texts = blocks.select("block", "texts")
    return texts.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(_cut(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

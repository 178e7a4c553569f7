"""Cost-balanced packing of tokenized documents into training sequences.

Every task tokenizes its own rows and packs them in blocks of bounded size, so
nothing is shuffled.  In a block of ``T`` tokens there are ``T // capacity``
sequences of full capacity, and the rest goes to sequences whose sizes are
the powers of two that add up to it: nothing is padded.  Documents longer
than a sequence first fill sequences of their own.  What remains is taken in
descending length; each goes to the sequence of lowest cost that has room for
it, cost being ``linear * n + quadratic * n * n`` summed over the pieces of a
sequence (attention does not cross documents).  Only if no sequence has room for
the whole, it is cut at the room of the cheapest, and what is left takes its place by length.

Tokenizing.  The tokenizer splits at white space, and most words further into runs of
letters, single digits and runs of other signs, so the ids of a text are those of its units one
after the other.  Each distinct unit of a piece of a batch is looked up in a bounded cache.  Units
that are missing are encoded in joined chunks, which the marks at unit ends take apart again.  Tokenizers with
other settings are refused.  Words
whose units this simple rule does not give (see ``_odd_words``) are encoded whole.

Defined cases: a null or empty text is one token (``end_id``); a null doc_id is
packed like any other; repeated rows are packed each; a very long text fills sequences of its own; an empty table gives no
piece; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import shared as S

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Bits of a sequence id that count within a task.
TASK_BITS = 40
#: Classes of bytes: digits, letters (also all bytes above ASCII) and others.
CLASS = np.zeros(256, np.uint8)
CLASS[48:58] = 1
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
#: The settings of the tokenizers that the rules below were written for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _odd_words(w: S.Words) -> np.ndarray:
    """Which words are not to be split by classes of bytes.

    They hold an apostrophe (contractions), ``<|`` (special tokens), or a character other than ASCII and the
    letters U+00C0 to U+023F but U+0130, which is two characters in lower case.
    """
    d = w.data
    after = np.zeros_like(d)
    after[:-1] = d[1:]
    bad = (d == 39) | ((d == 60) & (after == 124)) | (d >= 201) | ((d >= 192) & (d < 195))
    bad |= ((d == 195) & ((after == 151) | (after == 183))) | ((d == 196) & (after == 176))
    sums = np.zeros(len(d) + 1, np.int64)
    np.cumsum(bad, out=sums[1:])
    return sums[w.end] > sums[w.start]


class UnitEncoder:
    """Ids of whole rows by way of a cache of units."""

    def __init__(self, path: str, end_id: int, most: int = 600_000, chunk: int = 512):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.end_id, self.most, self.chunk = Tokenizer.from_file(path), end_id, most, chunk
        parts = json.loads(self.tok.to_str())
        if (parts["normalizer"], parts["pre_tokenizer"], parts["model"].get("end_of_word_suffix")) != (NORMALIZER, SPLITTER, "</w>"):
            raise ValueError("only tokenizers that lower-case, split words as _odd_words and CLASS tell, and mark word ends")
        self.batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        vocabulary = self.tok.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.number = {b"": 0}  # 0 stands for a document's end
        self.flat = np.zeros(1 << 16, np.uint32)
        self.flat[0] = self.end_id
        self.used = 1
        self.start, self.len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.len[0] = 1

    def _each(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.batch([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)]
        return np.fromiter((i for ids in got for i in ids), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        chunks = [b" ".join(units[i : i + self.chunk]).decode("utf-8", "replace") for i in range(0, len(units), self.chunk)]
        got = [np.array(e.ids, np.uint32) for e in self.batch(chunks, add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(units) or (len(ends) and ends[-1] != len(ids)):  # another kind of vocabulary
            return self._each(units)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        total, n = len(flat), len(self.number)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.start):
            self.start, self.len = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.len, np.zeros_like(self.len)])
        self.flat[self.used : self.used + total] = flat
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.len[n : n + len(words)] = sizes
        self.used += total
        self.number.update(zip(words, range(n, n + len(words))))

    def rows(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows lo..hi, each row closed by the end id, and how many each row has."""
        w = S.Words(data, off, lo, hi)
        odd = _odd_words(w)
        inside = np.zeros(len(w.data) + 1, np.int8)  # bytes of words that are left whole
        np.add.at(inside, w.start[odd], 1)
        np.add.at(inside, w.end[odd], -1)
        plain = np.cumsum(inside[:-1], dtype=np.int8) == 0
        raw = np.where(plain, LOWER[w.data], w.data)
        kind = CLASS[w.data]
        cut = np.zeros(len(w.data) + 1, bool)
        cut[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == 1)) & plain[1:]
        cut[w.start] = True
        solid = np.append(w._solid, False)
        start = np.flatnonzero(cut & solid)
        cut[w.end] = True
        cut[-1] = True
        edge = np.flatnonzero(cut)
        end = edge[np.searchsorted(edge, start, side="right")]
        h = S.Rolling(S._byte_values(1, False)[raw], 1).runs(start, end)
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        text = raw.tobytes()
        units = [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
        missing = [i for i, u in enumerate(units) if u not in self.number]
        if len(self.number) + len(missing) > self.most:
            self.reset()
            missing = list(range(len(units)))
        whole = ~plain[start[at]]
        for encode, mine in ((self._joined, False), (self._each, True)):
            new = [units[i] for i in missing if whole[i] == mine]
            if new:
                self._learn(new, *encode(new))
        number = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))[inverse]
        first = np.searchsorted(start, w.row_off)
        number = np.insert(number, first[1:], 0)  # each row's end
        counts = self.len[number]
        begin = np.cumsum(counts) - counts
        ids = self.flat[np.repeat(self.start[number] - begin, counts) + np.arange(int(counts.sum()))]
        ends = np.cumsum(counts)[first[1:] + np.arange(1, hi - lo + 1) - 1]
        return ids, np.diff(np.concatenate([[0], ends]))


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> UnitEncoder:
    """A Python worker keeps its encoder, and what it has cached, from task to task."""
    return UnitEncoder(path, end_id)


def pack(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block; every sequence ends full."""
    sequence = 0
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths.tolist()):
        at = 0
        while n - at >= capacity:
            yield i, at, capacity, sequence, 0
            sequence, at = sequence + 1, at + capacity
        if n > at:
            rest.append((at - n, i, at))
    heapq.heapify(rest)
    total = -sum(x[0] for x in rest)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    room, filled, cost = list(sizes), [0] * len(sizes), [0.0] * len(sizes)
    # lengths only fall, so a sequence waits by its room until they have come down to it, and then is ready for all that follow
    ready: list[tuple[float, int]] = []
    waits = [True] * len(sizes)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k, r in enumerate(sizes):
        waiting[r].append(k)
    short = [(0.0, k, r) for k, r in enumerate(sizes)]  # those that wait, by cost, and some that no longer do
    least = capacity + 1
    while rest:
        minus, i, at = heapq.heappop(rest)
        n = -minus
        while least > n:
            least -= 1
            for k in waiting[least]:
                if waits[k] and room[k] == least:
                    waits[k] = False
                    heapq.heappush(ready, (cost[k], k))
        if ready:
            k = heapq.heappop(ready)[1]
        else:
            k, r = -1, 0
            while k < 0 or not waits[k] or room[k] != r:
                _, k, r = heapq.heappop(short)
            waits[k] = False
        take = min(n, room[k])
        yield i, at, take, sequence + k, filled[k]
        room[k] -= take
        filled[k] += take
        cost[k] += linear * take + quadratic * take * take
        if room[k] >= n:
            heapq.heappush(ready, (cost[k], k))
        elif room[k]:
            waits[k] = True
            waiting[room[k]].append(k)
            heapq.heappush(short, (cost[k], k, room[k]))
        if n > take:
            heapq.heappush(rest, (take - n, i, at + take))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = 1 << 22) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    ``capacity`` is a power of two.  ``block_tokens`` bounds what a task holds at once.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches):
        context = TaskContext.get()
        task = (context.partitionId() if context else 0) << TASK_BITS
        encoder, held, tokens, done = None, [], 0, 0

        def flush():
            nonlocal done
            doc = pa.concat_arrays([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            sizes = np.concatenate([x[2] for x in held])
            begin = np.cumsum(sizes) - sizes
            out = np.array(list(pack(sizes, capacity, linear, quadratic)), dtype=np.int64).reshape(-1, 5)
            row, start, length, sequence, offset = out.T
            at = begin[row] + start
            order = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            edges = np.zeros(len(row) + 1, np.int32)
            np.cumsum(length * 4, out=edges[1:])
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(ids[order].astype("<u4"))])
            cols = [doc.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sizes[row]), pa.array(task + done + sequence), pa.array(offset), raw]
            done += int(sequence.max()) + 1
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or encoder_of(tokenizer_path, end_id)
            data, off = S.text_bytes(batch.column(1))
            for lo, hi in S.pieces(off):
                ids, sizes = encoder.rows(data, off, lo, hi)
                held.append((batch.column(0)[lo:hi], ids, sizes))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from flush()
                    held, tokens = [], 0
        if held:
            yield from flush()

    ship(docs.sparkSession)
    return S.texts(docs).mapInArrow(run, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (a run of spaces with what follows it, across which no piece reaches) are put
one after the other and indexed by a suffix array over as many characters as the longest
piece has.  Every piece is looked up by binary search; the range that it finds holds all its
occurrences.  These edges are sorted by position and relaxed segment by segment: in a unigram model to the path of highest score,
in a BPE model in order of merges, the best edge that joins two neighbours first, the leftmost of equals.  Characters without a piece
become bytes where the model has them.

A bounded cache of segments serves later batches.  Results equal the library's for models that take text as
it is (no normalization but the space mark, with a dummy prefix); others are refused.

Defined cases: a null or empty text has no ids and decodes to an empty text; a literal space mark (U+2581) decodes
to a space, as in the library; a null doc_id is kept; repeated rows get the same result each; a very long text is a block of its own,
with any number of different characters; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

MARK = 0x2581
#: Characters that are indexed at once, and segments above which a heap takes the place of rounds.
BLOCK_CHARS, LONG = 1 << 20, 48
NONE = np.int64(1 << 40)


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that take text as it is, with a dummy prefix")
        self.bpe = proto.trainer_spec.model_type == 2
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.byte = np.full(256, self.unknown, np.int64)
        texts, ids, self.raw = [], [], [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError("a piece reaches across a space")
                texts.append(piece)
                ids.append(i)
                self.raw[i] = piece.replace("▁", " ").encode()
        self.raw[self.unknown] = " ⁇ ".encode()
        self.ids = np.array(ids)
        self.score = np.array([sp.get_score(i) for i in ids])
        self.longest = max(map(len, texts))
        self.length = np.array(list(map(len, texts)))
        self.chars = np.zeros((len(texts), self.longest), np.uint32)
        for i, x in enumerate(texts):
            self.chars[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32)
        _, rank = np.unique(-self.score, return_inverse=True)
        self.rank = rank.astype(np.int64)  # equal scores have equal ranks
        size = np.array(list(map(len, self.raw)))
        self.raw_len, self.raw_at = size, np.cumsum(size) - size
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` or more characters, by doubling; ``text`` has numbers from 1 below 2**32."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(4, np.uint64)])
    have = 4 if n and text.max() < 1 << 16 else 2  # as many characters as a number of 64 bits holds
    key = padded[:n]
    for i in range(1, have):
        key = key << S.U64(64 // have) | padded[i : n + i]
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]])).astype(np.uint64)
        tail = np.zeros(n, np.uint64)
        tail[: max(0, n - have)] = rank[have:]
        key = rank << S.U64(32) | tail
        have *= 2


def occurrences(text: np.ndarray, order: np.ndarray, pieces: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each piece's range in the suffix array, by binary search of all pieces at once."""
    width = pieces.shape[1]
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    inside = np.arange(width)[None, :] < length[:, None]
    found = []
    for upper in (False, True):
        lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            x = padded[at[:, None] + np.arange(width)].astype(np.int64)
            diff = np.where(inside, x - pieces, 0)
            first = (diff != 0).argmax(1)
            sign = diff[np.arange(len(pieces)), first]
            right = ((sign <= 0) if upper else (sign < 0)) & (lo < hi)
            lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
        found.append(lo)
    return found[0], found[1]


def edge_table(text: np.ndarray, model: Model) -> np.ndarray:
    """len(text) x longest: number of the piece that begins at a place and has a length, or -1."""
    letters, dense = np.unique(text, return_inverse=True)
    at = np.searchsorted(letters, model.chars)
    known = (at < len(letters)) & (letters[np.minimum(at, len(letters) - 1)] == model.chars)
    usable = np.flatnonzero((known | (np.arange(model.longest) >= model.length[:, None])).all(1))
    order = suffix_array(dense.ravel() + 1, model.longest)
    begin, end = occurrences(dense.ravel() + 1, order, at[usable].astype(np.int64) + 1, model.length[usable])
    counts = end - begin
    piece = np.repeat(usable, counts)
    place = order[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
    by_place = np.argsort(place, kind="stable")
    place, piece = place[by_place], piece[by_place]
    table = np.full((len(text) + 1, model.longest), -1, np.int32)
    table[place, model.length[piece] - 1] = piece
    return table


def merge_all(start: np.ndarray, segment: np.ndarray, table: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (start, end) after all merges; one merge per segment and round, of all segments at once."""
    p, e, g = start, start + 1, segment
    done = []
    width = table.shape[1]
    while len(p):
        span = np.concatenate([e[1:], [0]]) - p
        ok = np.zeros(len(p), bool)
        ok[:-1] = g[1:] == g[:-1]
        ok &= span <= width
        piece = np.where(ok, table[p, np.clip(span, 1, width) - 1], -1)
        key = np.where(piece >= 0, rank[piece] << 32, NONE << 20) | np.arange(len(p))
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        best = np.minimum.reduceat(key, first)
        goes = best < NONE << 20
        sizes = np.diff(np.concatenate([first, [len(p)]]))
        stays = np.repeat(goes, sizes)
        done.append((p[~stays], e[~stays]))
        w = best[goes] & 0xFFFFFFFF
        e = e.copy()
        e[w] = e[w + 1]
        stays[w + 1] = False
        p, e, g = p[stays], e[stays], g[stays]
    p, e = (np.concatenate(x) for x in zip(*done)) if done else (start, start)
    o = np.argsort(p)
    return p[o], e[o]


def merge_long(lo: int, hi: int, table: np.ndarray, rank: np.ndarray) -> tuple[list[int], list[int]]:
    """The same for one long segment, by a heap of edges."""
    width = table.shape[1]
    end = {i: i + 1 for i in range(lo, hi)}
    before = {i: i - 1 for i in range(lo + 1, hi)}
    heap: list[tuple[int, int, int]] = []

    def offer(a):
        b = end[a]
        if b < hi and end[b] - a <= width:
            k = table[a, end[b] - a - 1]
            if k >= 0:
                heapq.heappush(heap, (int(rank[k]), a, end[b]))

    for i in range(lo, hi):
        offer(i)
    while heap:
        _, a, stop = heapq.heappop(heap)
        if a not in end or end[a] >= hi or end[end[a]] != stop:
            continue
        b = end[a]
        end[a] = stop
        del end[b]
        before.pop(b, None)
        if stop < hi:
            before[stop] = a
        offer(a)
        if a in before:
            offer(before[a])
    keys = sorted(end)
    return keys, [end[k] for k in keys]


def best_path(lo: int, hi: int, table: np.ndarray, score: np.ndarray, unknown: float) -> tuple[list[int], list[int]]:
    """Unigram: edges relaxed by position to the path of highest score."""
    top, back = [0.0] + [-np.inf] * (hi - lo), [0] * (hi - lo + 1)
    for i in range(hi - lo):
        row = table[lo + i, : hi - lo - i]
        options = [(int(k) + 1, score[row[k]]) for k in np.flatnonzero(row >= 0)]
        if row[0] < 0:
            options.append((1, unknown))
        for n, s in options:
            if top[i] + s > top[i + n]:
                top[i + n], back[i + n] = top[i] + s, i
    cuts = [hi - lo]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    cuts = [lo + c for c in reversed(cuts)]
    return cuts[:-1], cuts[1:]


def encode_segments(segments: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and how many each has."""
    chars = [np.frombuffer(x.decode("utf-8", "replace").replace(" ", "▁").encode("utf-32-le"), np.uint32) for x in segments]
    sizes = np.fromiter(map(len, chars), np.int64, len(chars))
    first = np.cumsum(sizes + 1) - sizes - 1  # a 0 stands between segments
    text = np.zeros(int(sizes.sum()) + len(chars), np.uint32)
    place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    text[place] = np.concatenate(chars) if chars else text[:0]
    segment = np.repeat(np.arange(len(chars)), sizes)
    table = edge_table(text, model)
    long = sizes > LONG if model.bpe else np.ones(len(sizes), bool)
    p, e = merge_all(place[~long[segment]], segment[~long[segment]], table, model.rank)
    if long.any():
        more = [merge_long(a, a + n, table, model.rank) if model.bpe else best_path(a, a + n, table, model.score, model.score.min() - 10) for a, n in zip(first[long].tolist(), sizes[long].tolist())]
        p = np.concatenate([p, *(np.array(x[0], np.int64) for x in more)])
        e = np.concatenate([e, *(np.array(x[1], np.int64) for x in more)])
        o = np.argsort(p)
        p, e = p[o], e[o]
    piece = table[p, e - p - 1]
    # what has no piece is spelled in bytes
    owner = np.searchsorted(first, p, side="right") - 1
    ids = model.ids[piece]
    lone = np.flatnonzero(piece < 0)
    if len(lone):
        spelled = [model.byte[np.frombuffer(chr(int(text[x])).encode("utf-8", "replace"), np.uint8)] for x in p[lone]]
        spelled = [s if (s != model.unknown).all() else s[:1] for s in spelled]
        count = np.ones(len(p), np.int64)
        count[lone] = [len(s) for s in spelled]
        at = np.cumsum(count) - count
        ids, flat = np.repeat(ids, count), ids
        for x, s in zip(at[lone].tolist(), spelled):
            ids[x : x + len(s)] = s
        owner = np.repeat(owner, count)
    return ids.astype(np.uint32), np.bincount(owner, minlength=len(chars))


class Encoder:
    """Ids of whole rows by way of a bounded cache of segments."""

    def __init__(self, path: str, most: int = 400_000):
        self.model, self.most = Model(path), most
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.start, self.len = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        lo, size, blocks = 0, 0, []
        for hi, x in enumerate(new):
            size += len(x) + 1
            if size >= BLOCK_CHARS:
                blocks.append(new[lo : hi + 1])
                lo, size = hi + 1, 0
        blocks.append(new[lo:])
        for block in filter(None, blocks):
            flat, sizes = encode_segments(block, self.model)
            self.number.update(zip(block, range(len(self.start), len(self.start) + len(block))))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.len = np.concatenate([self.len, sizes])
            self.flat = np.concatenate([self.flat, flat])

    def batch(self, data: np.ndarray, off: np.ndarray):
        """(lo, hi, ids, counts) for ranges of rows."""
        parts = []
        fresh: dict[bytes, None] = {}
        for lo, hi in S.pieces(off):
            # every text gets the dummy prefix
            n = np.diff(off[lo : hi + 1])
            full = np.flatnonzero(n)
            head = (off[lo:hi] - off[lo])[full]
            part = np.insert(data[off[lo] : off[hi]], head, 0x20)
            head = head + np.arange(len(head))
            space = part == 0x20
            first = space.copy()
            first[1:] &= ~space[:-1]
            first[head] = True
            start = np.flatnonzero(first)
            end = np.append(start[1:], len(part)) if len(start) else start
            h = S.Rolling(S._byte_values(21, False)[part], 21).runs(start, end)
            _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            raw = part.tobytes()
            words = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            fresh.update((w, None) for w in words if w not in self.number)
            counts = np.zeros(hi - lo, np.int64)
            counts[full] = np.diff(np.append(np.searchsorted(start, head), len(start)))
            parts.append((lo, hi, words, inverse.astype(np.int32), counts))
        if len(self.number) + len(fresh) > self.most:
            self.reset()
            fresh = {w: None for p in parts for w in p[2]}
        self._learn(list(fresh))
        for lo, hi, words, inverse, segments in parts:
            number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[inverse]
            counts = self.len[number]
            total = int(counts.sum())
            ids = self.flat[np.repeat(self.start[number] - (np.cumsum(counts) - counts), counts) + np.arange(total)] if total else np.zeros(0, np.uint32)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(segments)])]
            yield lo, hi, ids, np.diff(ends)


def decode_rows(ids: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and how many each has; the dummy prefix goes."""
    size = model.raw_len[ids]
    total = int(size.sum())
    out = model.raw_flat[np.repeat(model.raw_at[ids] - (np.cumsum(size) - size), size) + np.arange(total)] if total else np.zeros(0, np.uint8)
    sums = np.concatenate([[0], np.cumsum(size)])
    off = sums[np.concatenate([[0], np.cumsum(counts)])]
    full = np.flatnonzero(np.diff(off))
    lead = off[:-1][full]
    lead = lead[out[lead] == 0x20]
    gone = np.zeros(len(out) + 1, np.int64)
    gone[lead + 1] = 1
    keep = np.ones(len(out), bool)
    keep[lead] = False
    return out[keep], np.diff(off - np.cumsum(gone)[off])


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _list(values: np.ndarray, counts: np.ndarray):
    return S.list_array(values.astype(np.int32), counts, pa.int32())


def encode(docs: DataFrame, model_path: str, round_trip: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text; with ``round_trip`` also whether they decode to the text."""

    def work(batch):
        enc = encoder_of(model_path)
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        for lo, hi, ids, counts in enc.batch(data, off):
            cols = {"doc_id": t["doc_id"][lo:hi], "ids": _list(ids, counts)}
            if round_trip:
                out, sizes = decode_rows(ids, counts, enc.model)
                ends = np.cumsum(sizes)
                same = np.array_equal(out, data[off[lo] : off[hi]]) and np.array_equal(sizes, np.diff(off[lo : hi + 1]))
                cols["round_trip"] = np.ones(hi - lo, bool) if same else np.array([np.array_equal(out[e - s : e], data[off[lo + i] : off[lo + i + 1]]) for i, (e, s) in enumerate(zip(ends.tolist(), sizes.tolist()))])
            yield cols

    return S.map_arrow(S.texts(docs), work, "doc_id long, ids array<int>" + ", round_trip boolean" * round_trip)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of rows with ids; null ids decode to an empty text."""

    def work(batch):
        model = encoder_of(model_path).model
        c = batch.column(1)
        counts = np.nan_to_num(np.asarray(c.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
        out, sizes = decode_rows(c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts, model)
        ends = np.cumsum(sizes)
        raw = out.tobytes()
        yield {"doc_id": batch.column(0), "text": [raw[e - s : e].decode("utf-8", "replace") for e, s in zip(ends.tolist(), sizes.tolist())]}

    return S.map_arrow(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), round_trip=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "round_trip")

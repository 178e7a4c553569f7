"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles.  Band keys are made of full minima; of
each minimum the signature retains ``bits`` low bits, packed.  Candidates come from equal band
keys; the share of equal signature fields, found by counting bits and corrected for the 2**-bits of them that
collide by chance, must come near the threshold; what is left is confirmed on the full sets.

With 30 bands of 5 rows two documents at similarity 0.8 miss each other with
probability 7e-6, and those of 0.85 with 3e-8.

Groups of copies are never paired out.  Equal sets are one class.  In a bucket every class is
first compared with the least one, its representative; links join components.  While a bucket has
classes of different components, it takes more representatives, of the components
that are not its largest (all if the bucket has up to ``PART`` classes, else up to ``pivots``); all its classes are compared with them, and they leave it.
A round costs each bucket at most twice as many rows as it has classes, whatever its size, and the rounds end
when every bucket is of one component or empty, so all links between components are looked for.

Classes are named by 64 bits of their hashes; 1e9 different sets have two with one name at a chance of 3 %.

Defined cases: null text, or one without a word, has an empty set and links with nothing; a
text with fewer words than a shingle is one shingle; a null doc_id links with nothing and is
kept; rows with an equal doc_id are one node that has the links of all their texts (a row with an empty set
stays apart); repeated rows get the same result; a very long text is one row of a batch like any other; an empty table gives an empty
table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: Bits of a parity sketch.
SKETCH = 4096
#: Members of a bucket that meet its pivots in one part.
PART = 8192


def shingle_sets(data, off, lo, hi, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of rows lo..hi, and where each row begins, with an end mark."""
    w = S.Words(data, off, lo, hi)
    roll = S.Rolling(w.hashes(lower=True), 31)
    counts = np.where(w.counts >= size, w.counts - size + 1, (w.counts > 0).astype(np.int64))
    mark = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(hi - lo), counts)
    at = np.arange(mark[-1]) - mark[row] + w.first[row]
    h = roll.runs(at, at + np.minimum(size, w.counts[row]))
    return distinct_by_row(h, row, hi - lo)


def distinct_by_row(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(h)
    o = o[np.argsort(row[o].astype(np.uint16) if n < 1 << 16 else row[o], kind="stable")]
    h, row = h[o], row[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(n + 1))


def minima(h: np.ndarray, mark: np.ndarray, perms: int, seed: int = 41) -> np.ndarray:
    """rows x perms least values of the sets; rows without elements have the largest value."""
    r = np.random.default_rng(seed)
    a = r.integers(0, 2**31, perms, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = r.integers(0, 2**32, perms, dtype=np.uint32)
    out = np.full((len(mark) - 1, perms), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(mark))
    if len(full):
        x, start = (h >> S.U64(32)).astype(np.uint32), mark[:-1][full]
        for i in range(perms):
            out[full, i] = np.minimum.reduceat(x * a[i] + b[i], start)
    return out


def pack_bits(low: np.ndarray, bits: int) -> np.ndarray:
    """Rows of fields of ``bits`` (1, 2, 4 or 8) bits as bytes; the last byte is filled up with zeros."""
    per = 8 // bits
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % per))).astype(np.uint8).reshape(len(low), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint8) * np.uint8(bits)), axis=2)


def equal_fields(x: np.ndarray, y: np.ndarray, perms: int, bits: int) -> np.ndarray:
    """How many fields of packed signatures agree: each field's differences fold into its low bit, and those are counted."""
    diff = np.bitwise_xor(x, y)
    step = 1
    while step < bits:
        diff |= diff >> np.uint8(step)
        step *= 2
    low = np.uint8(sum(1 << b for b in range(0, 8, bits)))
    return perms - np.bitwise_count(diff & low).sum(-1, dtype=np.int64)


def similarity(x: np.ndarray, y: np.ndarray, perms: int, bits: int) -> np.ndarray:
    """Estimate from packed signatures, corrected for fields that are equal by chance."""
    return (equal_fields(x, y, perms, bits) / perms - 2.0**-bits) / (1 - 2.0**-bits)


def _signatures(size: int, bands: int, rows: int, bits: int):
    def work(batch):
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        for lo, hi in S.pieces(off):
            h, mark = shingle_sets(data, off, lo, hi, size)
            n = np.diff(mark)
            full = n > 0
            m = minima(h, mark, bands * rows)
            key = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], hi - lo, 0)
            for r in range(rows):
                key = S.mix(key * S.U64(0x9E3779B97F4A7C15) + m[:, r::rows].astype(np.uint64))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(S.mix(h + S.U64(s)), dtype=np.uint64)]) for s in (1, 2)]
            s1, s2 = ((x[mark[1:]] - x[mark[:-1]]).view(np.int64) for x in sums)
            sig = pack_bits(m & np.uint32((1 << bits) - 1), bits)
            yield {
                "doc_id": t["doc_id"][lo:hi], "tkey": t["tkey"][lo:hi], "n": n.astype(np.int64), "s1": s1, "s2": s2,
                "sig": pa.array([x.tobytes() if f else None for x, f in zip(sig, full)], pa.binary()),
                "bands": S.list_array(key[full].ravel().view(np.int64), full * bands, pa.int64()),
            }

    return work


def _confirm(size: int, percent: int):
    """Rows a, b, ta, tb: those with 100 * intersection >= percent * union of the full sets."""

    def work(batch):
        t = pa.Table.from_batches([batch])
        da, oa = S.text_bytes(t["ta"])
        db, ob = S.text_bytes(t["tb"])
        for lo, hi in S.pieces(oa + ob):
            n = hi - lo
            ha, ma = shingle_sets(da, oa, lo, hi, size)
            hb, mb = shingle_sets(db, ob, lo, hi, size)
            na, nb = np.diff(ma), np.diff(mb)
            h = np.concatenate([ha, hb])
            row = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)])
            _, mark = distinct_by_row(h, row, n)
            union = np.diff(mark)
            ok = (100 * (na + nb - union) >= percent * union) & (union > 0)
            yield {"a": t["a"][lo:hi].filter(pa.array(ok)), "b": t["b"][lo:hi].filter(pa.array(ok))}

    return work


def _sketches(size: int):
    """The size of each set and its parity sketch: one bit for each hash value's low bits, set if an odd number of elements has it."""

    def work(batch):
        t = pa.Table.from_batches([batch])
        data, off = S.text_bytes(t["text"])
        for lo, hi in S.pieces(off):
            h, mark = shingle_sets(data, off, lo, hi, size)
            n = np.diff(mark)
            row = np.repeat(np.arange(hi - lo), n)
            bit, odd = np.unique(row * SKETCH + (h & S.U64(SKETCH - 1)).astype(np.int64), return_counts=True)
            bits = np.zeros((hi - lo) * SKETCH, np.uint8)
            bits[bit[odd % 2 == 1]] = 1
            packed = np.packbits(bits.reshape(hi - lo, SKETCH), axis=1)
            yield {"v": t["v"][lo:hi], "n": n, "sketch": pa.array([x.tobytes() for x in packed], pa.binary())}

    return work


def _against_pivots(percent: int, perms: int, bits: int, least: float, best: bool):
    """Pairs of different components of a bucket's part, one of them a pivot, that may be links.

    ``best``: of a pivot's candidates only the nearest of each component, with key and pivot where others were held back.

    Their packed signatures must come near.  The sketches' odd bits are no more than the elements that only one
    of the two sets has, so a pair with more of them than a link may have is none.
    """

    def run(batches):
        for t, edges in S.whole_groups(batches, ["key", "part"]):
            v, comp, n = (t[c].to_numpy() for c in ("v", "comp", "n"))
            pivot = t["pivot"].to_numpy()
            sig, sketch = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(len(v), -1) for c in ("sig", "sketch"))
            sketch = sketch.view(np.uint64)
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                members = a + np.flatnonzero(pivot[a:b] == 0)
                for p in (a + np.flatnonzero(pivot[a:b] == 1)).tolist():
                    other = members[comp[members] != comp[p]]
                    share = similarity(sig[p], sig[other], perms, bits)
                    other, share = other[share >= least], share[share >= least]
                    odd = np.bitwise_count(sketch[p] ^ sketch[other]).sum(-1, dtype=np.int64)
                    ok = (100 + percent) * odd <= (100 - percent) * (n[p] + n[other])
                    other, share = other[ok], share[ok]
                    all_ = len(other)
                    if best and all_:
                        o = np.lexsort((share, comp[other]))
                        c = comp[other[o]]
                        other = other[o[np.append(c[1:] != c[:-1], True)]]
                    if len(other):
                        low, high = np.minimum(v[p], v[other]), np.maximum(v[p], v[other])
                        found.append(np.stack([low, high, *np.broadcast_arrays(t["key"][a].as_py(), v[p], int(all_ > len(other)), low)[:3]], 1))
            if found:
                x = np.concatenate(found)
                none = pa.array(x[:, 4] == 0)
                key, pivot_of = (pa.compute.if_else(none, None, pa.array(np.ascontiguousarray(x[:, i]))) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1])), key, pivot_of], names=["a", "b", "key", "pivot"])

    return run


def _relabel(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; only the components that they join are worked on."""
    a, b = (comps.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = S.components(between)
    moved = comps.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return S.materialize(moved.unionAll(joined.join(comps.select("id"), "id", "left_anti").select("id", "comp")), "components")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, bits: int = 4, pivots: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    if bits not in (1, 2, 4, 8):
        raise ValueError("bits must be 1, 2, 4 or 8")
    perms = bands * rows
    chance = percent / 100 + (1 - percent / 100) * 2.0**-bits  # that a field is equal
    near = percent / 100 - 4 * (chance * (1 - chance) / perms) ** 0.5 / (1 - 2.0**-bits)  # four standard errors below
    t = S.texts(docs).withColumn("tkey", F.xxhash64("text"))
    signed = S.materialize(S.map_arrow(t, _signatures(size, bands, rows, bits), "doc_id long, tkey long, n long, s1 long, s2 long, sig binary, bands array<long>"), "signatures")
    real = signed.where("n > 0 and doc_id is not null").withColumn("v", F.xxhash64("s1", "s2", "n"))
    one = F.min_by(F.struct("doc_id", "tkey", "sig", "bands"), F.struct("doc_id", "tkey"))
    reps = S.materialize(real.groupBy("v").agg(one.alias("x")).select("v", F.col("x.doc_id").alias("rep"), "x.tkey", "x.sig", "x.bands"), "representatives")
    flat = reps.select("v", F.explode("bands").alias("key"))
    stars = S.materialize(flat.groupBy("key").agg(F.min("v").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "stars")
    shared = S.materialize(flat.join(stars, "key").where("v > a").select("key", "a", F.col("v").alias("b")), "buckets")
    pairs = S.materialize(shared.select("a", "b").distinct(), "pairs")
    # only documents that share a bucket are looked at again
    wanted = pairs.select(F.col("a").alias("v")).unionAll(pairs.select(F.col("b").alias("v"))).distinct()
    wanted = reps.join(wanted, "v", "left_semi").select("v", F.col("rep").alias("doc_id"), "tkey")
    own = S.materialize(t.join(wanted, ["doc_id", "tkey"]).select("v", "text").dropDuplicates(["v"]), "candidates")
    sigs = reps.select("v", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = own.select(F.col("v").alias("a"), F.col("text").alias("ta"))
        b = own.select(F.col("v").alias("b"), F.col("text").alias("tb"))
        return S.materialize(S.map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb"), _confirm(size, percent), "a long, b long"), "links")

    def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        ca, cb = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose packed signatures come near the threshold."""

        def work(batch):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            ok = pa.array(similarity(x, y, perms, bits) >= near)
            yield {"a": batch.column(0).filter(ok), "b": batch.column(1).filter(ok)}

        sa, sb = (sigs.select(F.col("v").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
        return S.map_arrow(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb"), work, "a long, b long")

    first = S.materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    comps = S.components(confirmed(likely(first)))
    more = S.materialize(likely(apart(pairs.join(first, ["a", "b"], "left_anti"), comps)), "tried")
    comps = _relabel(comps, confirmed(more))
    # classes that have met the representative of their bucket, but not each other
    label = lambda members, comps, *more: members.join(comps, F.col("v") == F.col("id"), "left").select("key", "v", F.coalesce("comp", "v").alias("comp"), *more)
    open_, tried, sketches = shared.select("key", F.col("b").alias("v")), None, None
    while True:
        labelled = label(open_, comps)
        mixed = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 < c1")
        open_ = S.materialize(labelled.join(mixed.select("key", F.ceil(F.col("n") / PART).cast("long").alias("parts")), "key"), "open")
        if open_.isEmpty():
            break
        if sketches is None:
            sketches = own.join(open_.select("v").distinct(), "v", "left_semi").select("v", "text")
            sketches = S.materialize(S.map_arrow(sketches, _sketches(size), "v long, n long, sketch binary").join(sigs, "v"), "sketches")
        # the largest component of a bucket has no pivots; of the others, all in buckets of one part, else one for each slot
        largest = open_.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"))
        slot = F.when(F.col("parts") == 1, F.col("v")).otherwise(F.pmod(F.xxhash64("v", "key"), F.lit(pivots)))
        chosen = open_.join(largest, "key").where("comp <> most").groupBy("key", "parts", slot.alias("slot")).agg(F.min("v").alias("v"))
        chosen = S.materialize(chosen.select("key", "v", "parts"), "pivots")
        # first the nearest of each component, which joins most of them; then, of pivots that held others back, all that are still apart
        members, leading = open_.drop("comp"), chosen
        for best in (True, False):
            both = label(members, comps, F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"), F.lit(0).alias("pivot"))
            both = both.unionAll(label(leading, comps, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).withColumn("pivot", F.lit(1)))
            S.ship(docs.sparkSession)
            dealt = S.by_group(both.join(sketches, "v"), ["key", "part"])
            near_ones = S.materialize(dealt.mapInArrow(_against_pivots(percent, perms, bits, near, best), "a long, b long, key long, pivot long"), "near")
            found = near_ones.select("a", "b").distinct()
            found = S.materialize(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "tried")
            if not found.isEmpty():
                tried = found if tried is None else tried.unionAll(found)
                comps = _relabel(comps, confirmed(found))
            more = near_ones.where("key is not null").select("key", F.col("pivot").alias("v")).distinct()
            if not best or more.isEmpty():
                break
            leading = chosen.join(more, ["key", "v"], "left_semi")
            members = members.join(more.select("key").distinct(), "key", "left_semi")
        left = S.materialize(open_.select("key", "v").join(chosen.select("key", "v"), ["key", "v"], "left_anti"), "open")
        S.drop_table(chosen)
        S.drop_table(open_)
        open_ = left
    for table in (own, shared, pairs, stars):
        S.drop_table(table)
    # a document with several rows ties their classes
    of_row = real.select("doc_id", "v")
    several = of_row.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z").select("doc_id", "a")
    comps = _relabel(comps, of_row.join(several, "doc_id").select("a", F.col("v").alias("b")))
    of_class = reps.select("v", "rep").join(comps, F.col("v") == F.col("id"), "left").select("v", "rep", F.coalesce("comp", "v").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = S.materialize(of_class.join(least, "comp").select("v", "component_id"), "of_class")
    out = signed.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("s1", "s2", "n")).alias("v")).join(of_class, "v", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
                 ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
f AS (SELECT doc_id, unnest(shingles) AS x, len(shingles) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(doc_id, coalesce(comp.b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(comp.b, doc_id)) AS kept
FROM s LEFT JOIN comp ON s.doc_id = comp.a
"""

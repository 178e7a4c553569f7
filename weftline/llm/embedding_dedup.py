"""Near-duplicate embeddings by cross-polytope hashing.

A vector is scaled to length 1, filled up to a power of two and turned by
random signs and a fast Hadamard transform, three times over.  The hash of a turn
is the place and sign of the largest component, that is the nearest corner of the cross-polytope; a bucket is
two such corners.  Each table also probes the buckets of the next nearest corners.

Buckets hold no vectors, only their names and 256 signs of turned components.  Two signs of vectors at an
angle differ with a chance of angle / pi, so pairs of a bucket that differ in more signs than five standard errors above
what the threshold allows (a chance of 3e-7 for a link) are none.  The others' components are groups; each vector then goes once to its
group, where all pairs are verified by their cosine in double precision, which gives the links and their components.

Equal vectors of a label are one class with a multiplicity, so copies are never paired with
each other.  No pair is ever written out: a group gives each vector its number of links and hangs
linked ones on one of them.  Buckets and groups with more than ``block`` classes are split into
pairs of blocks; counting the links of n vectors that are all near takes all their pairs once.

Classes are named by 64 bits of a hash; 1e9 different vectors have two with one name at a chance of 3 %.

Defined cases: a vector with null label, or that is null, zero, or has null or non-finite
components, links with nothing; vectors of different lengths don't link; repeated rows count
as vectors; a null vec_id counts for the others' links and may join them but can't be a component's id, and is not kept;
components of double precision stay so; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


#: Signs of turned components that stand for a vector in a bucket.
SIGNS = 256


def bucket_codes(x: np.ndarray, tables: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n x (tables * probes) bucket numbers of unit vectors, the own bucket of each table first, and packed signs."""
    n, d = x.shape
    full = 1 << max(1, (d - 1).bit_length())
    x = np.concatenate([x, np.zeros((n, full - d))], axis=1)
    r = np.random.default_rng(seed)
    out = np.zeros((n, tables, probes), np.int64)
    rows, signs = np.arange(n), []
    for t in range(tables):
        corner, second, loss = [], [], []
        for _ in range(2):
            y = x
            for _ in range(3):
                y = hadamard(y * r.choice([-1.0, 1.0], full))
            if len(signs) * full < SIGNS:
                signs.append(y < 0)
            a = np.abs(y)
            top = np.argpartition(-a, min(3, full - 1), axis=1)[:, : min(3, full)]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(a, top, 1), axis=1, kind="stable"), 1)
            sign = (np.take_along_axis(y, top, 1) < 0).astype(np.int64)
            code = top * 2 + sign
            corner.append(code[:, 0])
            second.append(code[:, 1:])
            best = np.take_along_axis(a, top, 1)
            loss.append(best[:, :1] - best[:, 1:])
        # candidates: one corner replaced by its next or next but one, cheapest first
        m = 2 * full
        options = np.concatenate([second[0] * m + corner[1][:, None], corner[0][:, None] * m + second[1]], axis=1)
        order = np.argsort(np.concatenate(loss, axis=1), axis=1, kind="stable")
        out[:, t, 0] = corner[0] * m + corner[1]
        for p in range(1, probes):
            out[:, t, p] = options[rows, order[:, min(p - 1, options.shape[1] - 1)]]
        out[:, t] += t * m * m
    signs = np.concatenate(signs, axis=1)[:, :SIGNS]  # short vectors have fewer with few tables
    signs = np.pad(signs, ((0, 0), (0, SIGNS - signs.shape[1])))
    return out.reshape(n, tables * probes), np.packbits(signs, axis=1)


def _matrix(col, dims: int) -> np.ndarray:
    c = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps squares finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(tables: int, probes: int, seed: int):
    def work(batch):
        t = pa.Table.from_batches([batch])
        dims = t["embedding"].combine_chunks().value_lengths().to_numpy()
        for d in np.unique(dims):
            part = t.filter(pa.array(dims == d))
            codes, signs = bucket_codes(_unit(_matrix(part["embedding"], d)), tables, probes, seed)
            yield {"cid": part["cid"], "label": part["label"], "codes": S.list_array(codes.ravel(), np.full(len(codes), codes.shape[1]), pa.int64()), "signs": pa.array([r.tobytes() for r in signs], pa.binary())}

    return work


#: Buckets up to this size are compared all at once, and give their pairs.
SMALL = 32


def _sides(t: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two sides of the pair of blocks in rows a..b."""
    i, j = t["_i"][a].as_py(), t["_j"][a].as_py()
    if i == j:
        at = np.arange(a, b)
        return at, at
    block = t["_b"][a:b].to_numpy()
    return a + np.flatnonzero(block == i), a + np.flatnonzero(block == j)


def _near(most: int):
    """Of the pairs of blocks of buckets: links to a root for each class that comes near another by its signs."""

    def run(batches):
        for t, edges in S.whole_groups(batches, ["key", "_i", "_j"]):
            n, size = t.num_rows, np.diff(edges)
            cid, small = t["cid"].to_numpy(), np.repeat((size <= SMALL) & (t["_i"].to_numpy()[edges[:-1]] == t["_j"].to_numpy()[edges[:-1]]), size)
            group = np.repeat(np.arange(len(size)), size)
            signs = np.frombuffer(b"".join(t["signs"].to_pylist()), np.uint8).reshape(n, -1).view(np.uint64)
            out = []
            for gap in range(1, SMALL):
                r = np.flatnonzero((group[:-gap] == group[gap:]) & small[:-gap]) if gap < n else np.zeros(0, np.int64)
                if not len(r):
                    break
                r = r[np.bitwise_count(signs[r] ^ signs[r + gap]).sum(1, dtype=np.int64) <= most]
                out.append((cid[r], cid[r + gap]))
            for k in np.flatnonzero(~small[edges[:-1]]).tolist():
                left, right = _sides(t, int(edges[k]), int(edges[k + 1]))
                ok = np.zeros((len(left), len(right)), bool)
                for s in range(0, len(left), 256):
                    l = left[s : s + 256]
                    differ = np.zeros((len(l), len(right)), np.int64)
                    for w in range(signs.shape[1]):
                        differ += np.bitwise_count(signs[l, w][:, None] ^ signs[right, w][None, :])
                    ok[s : s + 256] = differ <= most
                if left is right:
                    np.fill_diagonal(ok, False)
                if ok.any():
                    base = int(edges[k])
                    ids = cid[base : int(edges[k + 1])]
                    out.append((ids, _local(ids, left - base, right - base, ok, left is right)))
            ids, root = (np.concatenate(x) for x in zip(*out)) if out else (cid[:0], cid[:0])
            far = ids != root
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], names=["id", "root"])

    return run


def _links(threshold: float):
    """Of one pair of blocks of a group: partners (with copies) of each class, and a root that it is linked with."""

    def run(batches):
        for t, edges in S.whole_groups(batches, ["key", "_i", "_j"]):
            ids, m, label = t["cid"].to_numpy(), t["m"].to_numpy(), t["label"].to_numpy()
            lists = t["embedding"].combine_chunks()
            dims = lists.value_lengths().to_numpy()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                left, right = _sides(t, a, b)
                for d in np.unique(dims[a:b]):
                    p, q = left[dims[left] == d], right[dims[right] == d]
                    if not len(p) or not len(q):
                        continue
                    x, y = _unit(_matrix(lists.take(pa.array(p)), d)), _unit(_matrix(lists.take(pa.array(q)), d))
                    ok = np.zeros((len(p), len(q)), bool)
                    for s in range(0, len(p), 256):
                        ok[s : s + 256] = (x[s : s + 256] @ y.T >= threshold) & (label[p[s : s + 256]][:, None] == label[q][None, :])
                    if left is right:
                        np.fill_diagonal(ok, False)
                    if not ok.any():
                        continue
                    n = np.zeros(b - a, np.int64)
                    np.add.at(n, p - a, ok @ m[q])
                    if left is not right:
                        np.add.at(n, q - a, m[p] @ ok)
                    has = n > 0
                    root = _local(ids[a:b], p - a, q - a, ok, left is right)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][has]), pa.array(n[has]), pa.array(root[has])], names=["id", "n", "root"])

    return run


def _local(ids, left, right, ok, same) -> np.ndarray:
    """For each class the least id of its component: everybody takes the least id it is linked with, until nothing changes."""
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, left, np.where(ok, root[right][None, :], np.iinfo(np.int64).max).min(1))
        if not same:
            np.minimum.at(new, right, np.where(ok, new[left][:, None], np.iinfo(np.int64).max).min(0))
        if (new == root).all():
            return root
        root = new


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, tables: int = 12, probes: int = 3, block: int = 2048, seed: int = 23) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    kind = "double" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "float"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("long").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = v.where(usable).withColumn("cid", F.xxhash64("label", "embedding"))
    classes = S.materialize(good.groupBy("cid", "label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("m")), "classes")
    coded = S.materialize(S.map_arrow(classes.select("cid", "label", "embedding"), _codes(tables, probes, seed), "cid long, label long, codes array<long>, signs binary"), "coded")
    S.ship(vectors.sparkSession)

    def meet(members: DataFrame, key: str, work, schema: str, what: str) -> DataFrame:
        sizes = members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        return S.materialize(S.by_group(S.in_blocks(members, sizes, key, "cid", block), [key, "_i", "_j"]).mapInArrow(work, schema), what)

    angle = np.arccos(threshold) / np.pi
    most = int(SIGNS * angle + 5 * (SIGNS * angle * (1 - angle)) ** 0.5)
    flat = coded.select("cid", "label", "signs", F.explode(F.array_distinct("codes")).alias("code")).select(F.xxhash64("label", "code").alias("key"), "cid", "signs")
    near = meet(flat, "key", _near(most), "id long, root long", "near")
    groups = S.components(near.select(F.col("id").alias("a"), F.col("root").alias("b")))
    grouped = classes.join(groups.select(F.col("id").alias("cid"), F.col("comp").alias("key")), "cid").select("key", "cid", "label", "m", "embedding")
    found = meet(grouped, "key", _links(threshold), "id long, n long, root long", "found")
    for table in (coded, near):
        S.drop_table(table)
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = S.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.join(n, F.col("cid") == n["id"], "left").drop("id").join(comp, F.col("cid") == comp["id"], "left")
    of_class = of_class.select("cid", "label", "embedding", "first", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("comp", "cid").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = S.materialize(of_class.join(least, "comp").select("cid", "label", "embedding", "n_links", "component_id"), "of_class")
    linked = good.join(of_class, ["cid", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(comp.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(comp.b, vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN comp ON e.vec_id = comp.a
"""

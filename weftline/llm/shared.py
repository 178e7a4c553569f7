"""Helpers that several operators share: written tables, Arrow plumbing, token hashing, components.

Token hashing works on whole Arrow batches at once.  A text is a run of
bytes; ``prefix[i] = sum(value[b] * base**i)`` in 64-bit wrap-around arithmetic
makes the hash of *any* run of bytes or words one subtraction and one multiply.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import no_shuffle_left, ship

#: Bytes of text that numpy works on at once; longer texts go alone.
PIECE_BYTES = 1 << 19
U64 = np.uint64
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


# --- tables -----------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is read from the session.  Only a local master
    may go without it; then a temporary folder serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/weftline-shared"
    return found.rstrip("/")


def materialize(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders ``by`` some columns, and read it back.

    This cuts the lineage with files that outlive executors; the shuffle
    files behind the table go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with no_shuffle_left(spark):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def bucketed(df: DataFrame, key: str, n: int, what: str) -> DataFrame:
    """:func:`materialize` dealt into ``n`` buckets of ``key``: grouping by it shuffles nothing.

    The table is only named while it is written and opened; its files are dropped like those of :func:`materialize`.
    """
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with no_shuffle_left(spark):
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).options(path=path, compression="zstd").saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    out.schema  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    out._weftline_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns; whatever else ``docs`` has stays out of the plan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def carried(docs: DataFrame, names) -> str:
    """The named columns as the end of a schema text."""
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in names)


def held_out(doc_id) -> F.Column:
    """True where crc32(doc_id as text) mod 4 is 2; such rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """mapInArrow where ``work`` takes a pyarrow Table of one batch and gives columns by name."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in _parse_datatype_string(schema).fields]
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for cols in work(batch):
                    yield pa.RecordBatch.from_arrays([_as_array(cols[n], arrow.field(n).type) for n in names], schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _as_array(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    return pa.array(x, type=kind)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of ``counts[i]`` consecutive ``values``."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# --- texts as bytes ----------------------------------------------------------
def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 offsets of the rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have up to ``most`` bytes together; a longer text goes alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


@lru_cache(maxsize=8)
def _byte_values(seed: int, lower: bool) -> np.ndarray:
    t = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    if lower:
        t[65:91] = t[97:123]
    return t


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the base is odd, so it has an inverse."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = int(np.random.default_rng(seed + 77).integers(1, 2**62)) * 4 + 3
        inv = pow(base, -1, 1 << 64)
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, inv):
            p = np.ones(size, dtype=np.uint64)
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * U64(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        have = (out[0], out[1])
        _POWERS[seed] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value over all bits (a bijection)."""
    h = h ^ (h >> U64(30))
    h = h * M1
    h ^= h >> U64(27)
    h *= M2
    h ^= h >> U64(31)
    return h


class Rolling:
    """Hashes of any run [i, j) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, seed: int):
        n = len(values)
        self.pw, self.inv = powers(n + 1, seed)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.pw[:n], out=self.sums[1:])

    def runs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.inv[i] + (j - i).astype(np.uint64) * M2)

    def fixed(self, k: int) -> np.ndarray:
        """Hash of [i, i + k) for every i where it fits."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.inv[: n - k + 1])


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows lo..hi of a batch: byte ranges and row of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int):
        self.base = int(off[lo])
        self.data = data[off[lo] : off[hi]]
        self.row_off = off[lo : hi + 1] - off[lo]
        n = len(self.data)
        solid = ~SPACE[self.data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = self.row_off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]  # rows follow each other without a space
        if len(inner):
            first[inner] |= solid[inner]
            last[inner - 1] |= solid[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: index of the first word of each row, with an end mark
        self.first = np.searchsorted(self.start, self.row_off)
        self.counts = np.diff(self.first)
        self._solid = solid

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        t = _byte_values(seed, lower)
        return Rolling(t[self.data], seed).runs(self.start, self.end)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


# --- content-defined anchors --------------------------------------------------
def sliding(h: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over h[i : i + w] for every i where it fits."""
    out, have = h, 1
    while have * 2 <= w:
        out = f(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = f(out[: len(out) - (w - have)], out[w - have :])
    return out


def anchors(h: np.ndarray, row_first: np.ndarray, k: int, m: int, only: np.ndarray | None = None) -> np.ndarray:
    """Positions of the grams of k that are least in some window of m tokens.

    ``h`` has the hash of every gram of k tokens of the concatenated rows;
    ``row_first`` the first token of each row, with an end mark.  A gram is
    chosen by the content of windows alone, so two rows that share a window
    share its anchors, and every window has at least one.  ``only`` marks the
    windows (by first token) that count.
    """
    w = m - k + 1
    n = len(h) + k - 1
    if n < m:
        return np.zeros(0, np.int64)
    key = (h >> U64(32)).astype(np.uint32)
    least = sliding(key, w, np.minimum).copy()
    # windows that cross a row's end count for nothing
    ends = row_first[1:-1]
    if len(ends):
        cross = np.zeros(len(least) + 1, np.int32)
        lo = np.clip(ends - m + 1, 0, len(least))
        hi = np.clip(ends, 0, len(least))
        np.add.at(cross, lo, 1)
        np.add.at(cross, hi, -1)
        bad = np.cumsum(cross[:-1]) > 0
    else:
        bad = np.zeros(len(least), bool)
    if only is not None:
        bad |= ~only[: len(bad)]
    least[bad] = 0
    padded = np.concatenate([np.zeros(w - 1, np.uint32), least, np.zeros(w - 1, np.uint32)])
    best = sliding(padded, w, np.maximum)  # best[i]: over the windows that hold gram i
    ok = best == key
    if bad.any():
        good = np.concatenate([np.zeros(w - 1, np.int8), (~bad).astype(np.int8), np.zeros(w - 1, np.int8)])
        ok &= sliding(good, w, np.maximum) > 0
    return np.flatnonzero(ok)


# --- connected components ------------------------------------------------------
def components(links: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """Smallest reachable id of every id that has a link: columns id, comp.

    Each round hangs every node under its least neighbour, shortens the trees
    by one jump and contracts the links; a component at least halves, so the
    rounds grow with the logarithm of its size.  Links, nodes and labels stay
    distributed; every round is a written table.
    """
    edges = materialize(links.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b").distinct(), "links")
    total: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("id"), "p"), "parents")
        while True:  # until every tree is a star
            over = up.select(F.col("id").alias("_p"), F.col("p").alias("_pp"))
            jumped = materialize(up.join(over, F.col("p") == F.col("_p")).select("id", F.col("_pp").alias("p"), (F.col("_pp") != F.col("p")).alias("moved")), "parents")
            drop_table(up)
            up = jumped
            if up.where("moved").isEmpty():
                break
        up = up.select("id", "p")
        if total is None:
            total = up.select("id", F.col("p").alias("comp"))
        else:
            total = materialize(total.join(up.select(F.col("id").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), "components")
        new = edges.join(up.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        contracted = materialize(new.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        drop_table(edges)
        edges = contracted
    if total is None:
        total = links.sparkSession.createDataFrame([], "id long, comp long")
    return total


# --- sorted groups ---------------------------------------------------------------
def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups, with the groups' edges, of batches sorted by the long columns ``keys``.

    Only one unfinished group is carried from batch to batch.
    """

    def changes(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held and any(held[-1][k][-1] != t[k][0] for k in keys):
            done = pa.concat_tables(held).combine_chunks()
            held = []
            yield done, np.array([0, done.num_rows])
        cut = changes(t)
        if len(cut):
            done = pa.concat_tables([*held, t[: int(cut[-1])]]).combine_chunks()
            at = changes(done)
            held = [t[int(cut[-1]) :]]
            yield done, np.concatenate([[0], at, [done.num_rows]])
        else:
            held.append(t)
    if held:
        done = pa.concat_tables(held).combine_chunks()
        yield done, np.array([0, done.num_rows])


def by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deal rows by ``keys`` and sort them, for :func:`whole_groups`; the callers bound the size of a group."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def in_blocks(df: DataFrame, sizes: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Split the groups of ``df`` with more than ``block`` rows: adds _i and _j.

    ``sizes`` has ``key`` and n.  The members of a group of n are dealt into
    ceil(n / block) blocks by a hash of ``ident``; a row goes to each pair of blocks
    (i <= j) that has its own.  Every pair of members meets in exactly one such pair.
    """
    j = df.join(sizes.select(key, "n"), key)
    blocks = F.ceil(F.col("n") / block).cast("int")
    j = j.withColumn("_b", F.pmod(F.xxhash64(ident, F.lit(29)), blocks.cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return j.withColumn("_o", other).withColumn("_i", F.least("_b", "_o").cast("long")).withColumn("_j", F.greatest("_b", "_o").cast("long")).drop("_o", "n")

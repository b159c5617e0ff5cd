"""Shared helpers: reading tables, the cluster's shared folder, Arrow batch slicing, word arrays and components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs on one machine (tests), a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if not set_before:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='snapforge-')}")
        set_before = spark.sparkContext.getCheckpointDir()
    return set_before.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """While a stage of long texts or of blobs runs, Arrow batches hold fewer rows, as both the JVM and Python hold a whole batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of materialised tables that nothing will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back to the system at its end: a worker lives on for tasks of other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it has its own ways


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of batch that hold about `limit` bytes of `column` each; one row may be longer and is then alone."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end (null counts as empty) and the n+1 row offsets."""
    col = pa.compute.fill_null(col, "")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    n, buffers = len(col), col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: ASCII white space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words when punctuation is ignored: ASCII that is neither letter nor digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of all rows, and the number of words before each row (n+1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end where rows end
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= gaps[data[1:]] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 2 << 20:
        _POWERS[base] = have
    return have[:n]


def hashed_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of random values, the same wherever it stands: a polynomial over them, finalised with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=total[1:])
    own = (total[ends] - total[starts]) * _powers(_INVERSE, len(values))[starts]
    return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """hashed_spans of bytes."""
    return hashed_spans(_TABLE[data], starts, ends)


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


#: Edges that a task contracts at once.
CONTRACTED = 500_000


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component of the edges, edges from its least vertex to all its others."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    tail = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[tail]], ids[tail]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as the stars of its own components."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in ("u", "v"))
        held.clear()
        u, v = local_stars(u, v)
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > CONTRACTED:
            held.append(stars())
            if held[0].num_rows > CONTRACTED // 2:  # mostly stars already
                yield held.pop()
    if held:
        yield stars()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """(id, component_id): the smallest id that `edges` (a, b: long) reach from each id that has an edge.

    Each task first contracts its own edges to stars, of which few tasks of CONTRACTED edges each contract what is left, as long as
    that makes them fewer: a graph of no more edges is done then. For larger ones large-star and small-star steps alternate, and each
    round's edges are contracted again and written to the shared folder, the last round's deleted, until all edges are stars. No group
    meets in one task but as min(). A star's centre is one key of a sort-merge join whose other side has one row for it: adaptive
    execution splits it. The last round's folder stays, as the result reads it.
    """
    pairs = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v")
    stars = lambda rows: materialise(rows.mapInArrow(frugal(contract), "u long, v long"), "edges")
    pairs = stars(pairs)
    tasks, left = None, pairs.count()
    while tasks != 1 and (tasks is None or left < before // 2):
        tasks, before, old = left // CONTRACTED + 1, left, pairs
        pairs = stars(pairs.coalesce(tasks))
        left = pairs.count()
        discard(old)
    for _ in range(rounds):
        ends = pairs.select(F.col("u").alias("x"), F.lit(None).cast("long").alias("head")).union(pairs.select(F.col("v").alias("x"), F.col("u").alias("head")))
        # a star's vertex has one head, or is one: several tasks may have found the same edge
        if ends.groupBy("x").agg(F.min("head").alias("lo"), F.max("head").alias("hi"), F.max(F.col("head").isNull()).alias("is_head")).where("lo < hi OR is_head AND lo IS NOT NULL").isEmpty():
            break
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # large star: each larger neighbour y of x is linked to the least of x and its neighbours
        large = both.join(least, "x").where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u < v")
        # small star: the neighbours of v that are not larger, and v, are linked to the least of them
        small = large.join(large.groupBy("v").agg(F.min("u").alias("m")), "v")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), "v"))).alias("e")).select("e.u", "e.v").where("u < v")
        old, pairs = pairs, stars(small.coalesce(max(1, left // CONTRACTED + 1)))
        left = pairs.count()
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = pairs.select(F.col("u").alias("id"), F.col("u").alias("component_id")).union(pairs.select("v", "u"))
    return ends.groupBy("id").agg(F.min("component_id").alias("component_id"))

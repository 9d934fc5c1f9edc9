"""Shared helpers of the llm operators: checkpoints, Arrow text batches, word hashing, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at once; it bounds a task's memory, not what is read.
PIECE_BYTES = 2_000_000

SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Narrow rows for which a checkpoint has a part, where their number is known.
PART_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share: ``spark.checkpoint.dir``, or what the context has.
    A temporary one is made only on a local master, as in tests; on a cluster it would be one machine's own."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if have is None:
        if not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="brinework-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(have)
    return have


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that a run wrote for itself, on any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(spark: SparkSession) -> set[str]:
    """The folders of checkpoints that this application has written so far."""
    checkpoint_dir(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in store.listStatus(where)} if store.exists(where) else set()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is checkpointed within goes at the end, when the result has been written elsewhere."""
    before = written(spark)
    yield
    for path in written(spark) - before:
        discard(spark, path)


def passed(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` gave, which nothing reads any more: what is made of them has been written."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            discard(df.sparkSession, path)


#: Seconds between two sweeps by ``cut``.
SWEEP_SECONDS = 2.0
_swept = [0.0]


def cut(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that a lost executor costs no rerun
    of what came before. A bound on the rows, where known, keeps small results in few files. ``passed`` takes the files away.

    Shuffle files of what came before go when the driver collects its garbage, which a job of many small steps would
    else put off until they fill the disks; so it is asked to, now and then."""
    before = written(df.sparkSession)
    if most_rows is not None:
        df = df.coalesce(4 + most_rows // PART_ROWS)
    out = df.checkpoint()
    new = written(df.sparkSession) - before
    out._cut_path = new.pop() if len(new) == 1 else None  # of several, made by other threads too, none is known for sure
    if time.monotonic() - _swept[0] > SWEEP_SECONDS:
        collect_garbage(out.sparkSession)
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Ask the driver, Python and JVM, to collect its garbage: shuffle files go, the JVM's heap shrinks again, and what its
    many threads freed outside of the heap goes back to the system, which was 170 MB after a few rounds of ``near_dups``."""
    gc.collect()
    spark._jvm.System.gc()
    trim_jvm(spark)
    _swept[0] = time.monotonic()


def trim_jvm(spark: SparkSession) -> str | None:
    """What the driver's JVM says of giving freed native memory back, by its management bean; None where it knows no such
    command, as before Java 17.0.9 or outside of glibc."""
    jvm = spark._jvm
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """What ``make`` gives, kept in this Python worker under ``key`` until another key is asked for: workers are reused
    from stage to stage, so one that kept every stage's tables would grow with the length of a pipeline."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what this Python worker holds of earlier tasks."""
    _held.clear()
    _powers.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system, as the allocators would keep it for this process alone."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


#: Bytes of an Arrow batch between the JVM and Python: ten thousand whole texts at once would be tens of megabytes, held
#: several times.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to ``BATCH_BYTES``. The setting outlives the call, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes in ``column``; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    col = batch.column(column)
    sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64))
    at, total = 0, 0.0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0.0
        total += n
    yield batch.slice(at)


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and each row's start with the end appended; nulls count as empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def is_word_table(separators: bytes) -> np.ndarray:
    mask = np.ones(256, dtype=bool)
    mask[list(separators)] = False
    return mask


def word_bounds(data: np.ndarray, rows: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word, with the count of words appended.
    A row's end ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    w = is_word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edges = rows[:-1][rows[:-1] < rows[1:]]
    first[edges] = w[edges]
    tails = rows[1:][rows[:-1] < rows[1:]] - 1
    last[tails] = w[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, rows)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least ``n`` of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 4096), dtype=np.uint64)
        out[1:] = np.uint64(base)
        have = np.multiply.accumulate(out)
        if n <= PIECE_BYTES:  # those for a very long text are not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of ``x`` moves every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums of one polynomial over all bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    back = _power(_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts])


#: Rows that a task of a join may have of one key, at least; and keys with more of them, at most.
KEY_ROWS, HOT_KEYS = 100, 10_000
#: Pairs of ids up to which one task can take them all, so that a plain join does.
FEW_PAIRS = 200_000


def joined_by_key(rows: DataFrame, facts: DataFrame, key: list[str], size: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with ``facts``, which has one row for each ``key`` and in ``size`` how many of the ``n`` rows it has. A key
    with over ``n / HOT_KEYS`` rows fills no task: there are at most ``HOT_KEYS`` such keys, whose facts are broadcast to
    where the rows are. All other keys are joined by shuffle."""
    most = max(KEY_ROWS, n // HOT_KEYS)
    hot, few = facts.where(F.col(size) > most).drop(size), facts.where(F.col(size) <= most).drop(size)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(few, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def with_least(df: DataFrame, key: list[str], value: str, name: str, n: int) -> DataFrame:
    """``df`` (of ``n`` rows) with the least ``value`` of all rows with the same ``key``; a hot key fills no task."""
    if n <= FEW_PAIRS:
        return df.join(df.groupBy(*key).agg(F.min(value).alias(name)), key)
    return joined_by_key(df, df.groupBy(*key).agg(F.min(value).alias(name), F.count("*").alias("_size")), key, "_size", n)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable, by alternating large-star and
    small-star. Each step is a least per node and a join back in which a hub's neighbours fill no task. Null ids are dropped; an empty input gives an empty result."""
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(links, large: bool, n: int):
        """Large: v > u go to the least of u and its neighbours. Small: u and its smaller neighbours do."""
        if large:
            links = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = with_least(links, ["u"], "v", "m", n).withColumn("m", F.least("u", "m"))
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).distinct()

    before = state(edges)  # stars have no more edges than before, and at most one more for each node
    for _ in range(most_rounds if before[0] else 0):
        earlier, edges = edges, cut(star(star(edges, True, 2 * before[0]), False, before[0]), 2 * before[0])
        after = state(edges)
        passed(earlier)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

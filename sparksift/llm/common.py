"""Shared pieces: checkpoint folder, hot-key joins, Arrow text buffers."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of the six ASCII white-space characters, as a Java regular expression.
WS = r"[\x20\x09-\x0D]+"
#: The same six characters, for trim().
WS_CHARS = " \t\n\x0b\x0c\r"
#: A key is hot when it holds more than 1/HEAVY_PARTS of all rows, so there are fewer than HEAVY_PARTS hot keys whatever the data.
HEAVY_PARTS = 1000
#: So many rows at most are broadcast where their number was counted first.
BROADCAST_ROWS = 200_000
#: Fewer rows than this in a group never make its key hot.
HEAVY_LEAST = 20_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the cluster names in spark.checkpoint.dir. Only a single-process session without one gets a folder of this machine."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparksift-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint, which outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more; it does so when the driver's garbage is collected, by itself too late for a disk's sake."""
    for _ in range(2):  # the first collection drops what Python held, the second what that held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def text_of(column: str) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does that for pure ASCII, and is much faster than translate()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined null-safely to right, which has one row per key and in `count` the rows of left with it.

    The fewer than HEAVY_PARTS hot keys are broadcast, so that no task gets all
    rows of one; the rest is shuffled. left is read twice: checkpoint it first.
    """
    limit = max(HEAVY_LEAST, total // HEAVY_PARTS)
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    drop = [f"__r_{k}" for k in keys]
    if total <= limit:
        return left.join(r, on, how).drop(*drop)
    hot, rest = r.where(F.col(count) > limit), r.where(F.col(count) <= limit)
    marks = hot.select(*drop)
    a = left.join(F.broadcast(hot), on, "inner")
    b = left.join(F.broadcast(marks), on, "left_anti").join(rest, on, how)
    return a.unionByName(b).drop(*drop)


def drop_rows(docs: DataFrame, judged: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of docs without those that judged(id, key, kept) drops, with all their columns.

    A row is found by its id and `key`, a hash of its text. Where rows repeat both
    and only some are kept, one stays. Up to BROADCAST_ROWS dropped keys are broadcast.
    """
    sums = cut(judged.groupBy("id", "key").agg(F.max("kept").alias("some"), F.min("kept").alias("every")).where(~F.col("every")))
    gone = sums.select(F.col("id").alias("__sparksift_id"), F.col("key").alias("__sparksift_key"), "some")
    n, again = gone.agg(F.count(F.lit(1)), F.coalesce(F.max("some"), F.lit(False))).first()
    gone = F.broadcast(gone) if n <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    rows = docs.withColumn("__sparksift_k", key)
    on = rows[id_col].eqNullSafe(F.col("__sparksift_id")) & (rows["__sparksift_k"] == F.col("__sparksift_key"))
    if not again:
        return rows.join(gone, on, "left_anti").select(*docs.columns)
    rest = rows.join(gone, on, "left_anti")
    one = rows.join(gone.where("some"), on, "left_semi").dropDuplicates([id_col, "__sparksift_k"])
    return rest.unionByName(one).select(*docs.columns)


def trimmed(result=None):
    """The same, once the memory that this Python worker no longer uses is given back to the system: idle workers stay alive beside the executor's heap."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
    return result


def tidy(run):
    """A mapInArrow function that gives memory back at its end."""

    def wrapped(batches):
        yield from run(batches)
        trimmed()

    return wrapped


def merged(run, rows: int = 1000, size: int = 4 << 20):
    """A mapInArrow function whose batches of few rows are joined: each batch costs the JVM about as much as hundreds of rows."""

    def wrapped(batches):
        waiting: list = []
        n = held = 0
        for b in run(batches):
            waiting.append(b)
            n, held = n + b.num_rows, held + b.nbytes
            if n >= rows or held >= size:
                yield pa.concat_batches(waiting)
                waiting, n, held = [], 0, 0
        if waiting:
            yield pa.concat_batches(waiting)

    return wrapped


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without nulls, and where each value starts; the last offset ends the last."""
    wide = np.int64 if "large" in str(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def spans(offsets: np.ndarray, limit: int):
    """Ranges of consecutive values that hold about `limit` bytes; a larger value gets one of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

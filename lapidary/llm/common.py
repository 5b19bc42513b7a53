"""Shared helpers: scratch tables in the shared folder, what Python workers keep, two-level running sums, joins of hot keys, Arrow text buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: White space of the word contracts: space and U+0009..U+000D.
SPACE = (9, 10, 11, 12, 13, 32)
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the vectorised functions take at once, but for longer single texts.
SLICE_BYTES = 1 << 18
#: Base of the polynomial hashes, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. A temporary one only if it names none and all runs on this
    machine (tests): executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lapidary-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends here, executors may be lost."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    freed(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lapidary_path = path
    return out


def freed(spark: SparkSession) -> None:
    """Shuffle files of finished plans go when the driver collects its garbage."""
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of saved() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_lapidary_path", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


_held: dict[str, Any] = {}


def held(name: str, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, one object at a time: a worker serves all stages of a session, so what an earlier
    one left goes first."""
    if name not in _held:
        release()
        _held[name] = build()
    return _held[name]


def release() -> None:
    """Frees what the worker keeps."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow() of a function that keeps nothing in its worker."""

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        return run(batches)

    return df.mapInArrow(free, schema)


def running(df: DataFrame, keys: list[str], by: list[str], value: Column, into: str, rows_per_slice: int = 50_000) -> DataFrame:
    """Adds `into`: the sum of value over the rows before this one, per keys. The order is (slice, *by), where the slice is a
    hash of `by`: each key is cut into slices of about rows_per_slice rows, summed apart and joined by the slices' own running
    sums, so that a key with any share of the rows is never one task. Rows must be distinct in (*keys, *by) for a fixed result."""
    n = df.count()
    slices = max(1, -(-n // rows_per_slice))
    df = df.withColumns({"_v": value.cast("long"), "_slice": F.pmod(F.xxhash64(*by), F.lit(slices)).cast("int")})
    per = df.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"), before.alias("_base"))
    inner = F.coalesce(F.sum("_v").over(W.partitionBy(*keys, "_slice").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_slice") == F.col("_s")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        df.withColumn("_in", inner)
        .join(base, cond)
        .withColumn(into, F.col("_in") + F.col("_base"))
        .drop("_v", "_slice", "_in", "_s", "_base", *[f"_k_{k}" for k in keys])
    )


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, by: list[str], drop: list[str] | None = None) -> DataFrame:
    """left joined by key with right, a written table of one row a key that says in column n how many rows of left have it. A key with
    more than a quarter of a shuffle partition's share is dealt over several tasks by a hash of left's columns `by`, right's row going to
    each. There are at most four such keys a partition, so the driver can name them. Columns in `drop` go before the shuffle."""
    total, most = right.agg(F.sum(n), F.max(n)).first()
    share = max(1_000, int(total or 0) // (4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    one, none = F.lit(1), F.pmod(F.xxhash64(key), F.lit(1)).cast("int")  # always 0, and the same plan with frequent keys or without
    if (most or 0) <= share:
        parts, rows = one, right.withColumn("_part", none)
    else:
        classes: dict[int, list] = {}  # keys by the power of two of their parts
        for k, count in right.where(F.col(n) > share).select(key, n).collect():
            classes.setdefault(1 << (-(-count // share) - 1).bit_length(), []).append(k)
        parts = one
        for p, keys in classes.items():
            parts = F.when(F.col(key).isin(keys), p).otherwise(parts)
        many = right.where(F.col(n) > share).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = right.where(F.col(n) <= share).withColumn("_part", none).unionByName(many)
    left = left.withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop(*(drop or []))
    return left.join(rows.drop(n), [key, "_part"]).drop("_part")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary Arrow column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterable[pa.RecordBatch]:
    """Cuts a batch at rows so that a slice has about most_bytes of the column (a longer row stands alone)."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; tables of a slice's length are kept, longer ones (of a long text) are not."""

    def table(n: int) -> np.ndarray:
        p = np.full(n, np.uint64(base))
        p[0] = 1
        return np.multiply.accumulate(p)

    if n > SLICE_BYTES + 1:
        return table(n)
    if base not in _powers:
        _powers[base] = table(SLICE_BYTES + 1)
    return _powers[base][:n]


def running_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash, modulo 2**64; see between()."""
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power(BASE, len(raw)), out=total[1:])
    return total


def between(total: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """The hashes of stretches of the text that running_hash() read, wherever they stand."""
    with np.errstate(over="ignore"):
        return (total[end] - total[start]) * power(INVERSE, len(total))[start]


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of many stretches that do not overlap, in order: a slice's length of text at a time."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        total = running_hash(raw[start[i] : end[j - 1]])
        out[i:j] = between(total, start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return out


def words_at(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not space (a mask by byte value); a text's end ends its word."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = space[raw]
    word = ~gap[1:-1]
    begins, ends = word & gap[:-2], word & gap[2:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    begins[edge] = word[edge]
    ends[edge - 1] = word[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on uint64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

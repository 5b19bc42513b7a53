"""Sales put together from rows that arrive over days: a stateful stream that closes an assembly when it is complete or too old.

Rows are gathered by (sale, day) before they meet, so that a sale with any share of the rows is a row or two a day; what a sale is due is summed
from the whole input by the same grouping. The rows of each batch of days are appended to a folder, and a streaming query over that
folder is started anew for each batch on one checkpoint: transformWithStateInPandas on RocksDB, event time being the day. On their way
to the state, a task's rows are packed by key, so that what is shuffled and handed to Python are a few long records.

The state value of a key is its open assemblies, one record for each sale_id. A timer stands at the day on which the oldest of them
closes: registered when that assembly opens, deleted when it completes (then the next oldest has it). Day by day a sale's rows join its
assembly or open one; if it holds its sale, a line and cents equal to what is due, it closes as complete. After a batch's data the watermark,
the largest day of the batches before, fires the timers. A sentinel row in the last batch carries the watermark past every timer, and
the batch without data that follows closes the rest.

A key is a group of about `sales_per_key` sales by hash (1: each sale_id is a key): one call of the processor, with its state and timer, costs
about as much for thousands of sales as for one. Keys' number follows the input.

Defined results: rows of either table without sale_id are dropped; equal rows of sale_lines count once, compared in all their columns (by
sale, day, cents and a 64-bit hash of the whole row); a null line_no is left out of the hashed name; a null or non-finite amount or total is 0 cents; a sale without arrival day arrives on the first
day; of several rows of one sale the earliest (then the least total) says what is due. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import dropped, freed, mapped, saved, scratch_root

FIRST_DAY, DAYS, BATCHES, WAIT_DAYS, SALES_PER_KEY = 19723, 160, 10, 10, 8_000
#: In event time a day is a second and days are counted from long before year 1: every day that a timestamp can hold is then after the
#: first watermark and within the range of pandas.
SHIFT, DAY_MS, SENTINEL_DAY = 1_000_000, 1_000, 4_000_000
FEED = "key long, sale_id long, day int, n_lines long, cents long, held boolean, due long"
CLOSINGS = "sale_id long, first_day long, last_day long, n_lines long, cents long, due long, status string, closing_batch int"
PACKED = "key long, at timestamp, records binary"
PACK_ROWS = 1_000_000
ROW = np.dtype([("sale_id", "<i8"), ("day", "<i8"), ("n_lines", "<i8"), ("cents", "<i8"), ("due", "<i8"), ("held", "?")])
OPEN = np.dtype([("sale_id", "<i8"), ("first_day", "<i8"), ("last_day", "<i8"), ("n_lines", "<i8"), ("cents", "<i8"), ("due", "<i8"), ("held", "?")])
STREAMING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every start keeps 4 MB of disk for each partition
}
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def cents_of(amount: Column) -> Column:
    whole = F.floor(F.lit(100) * amount + F.lit(0.5))
    return F.when(amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != F.lit(math.inf)), whole).otherwise(F.lit(0)).cast("long")


def lines_by_day(lines: DataFrame) -> DataFrame:
    """sale_id, day, n_lines, cents of the distinct lines."""
    number = F.crc32(F.concat_ws(":", F.col("sale_id").cast("string"), F.col("line_no").cast("string")))
    shipped = F.unix_date(F.to_date("shipped_at")) + number % 15
    day = F.coalesce(shipped, FIRST_DAY + number % 152).cast("int")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in lines.columns])
    each = lines.where("sale_id IS NOT NULL").select("sale_id", day.alias("day"), cents_of(F.col("amount")).alias("cents"), row.alias("row")).distinct()
    return each.groupBy("sale_id", "day").agg(F.count("*").alias("n_lines"), F.sum("cents").alias("cents"))


def days_of_sales(sales: DataFrame, by_day: DataFrame) -> DataFrame:
    """Adds to lines_by_day() the days of the sales' own rows (held, no lines) and what each sale is due. A sale has at most a row a day
    of either kind, so its days fit a row."""
    by_sale = by_day.groupBy("sale_id").agg(
        F.sum("cents").alias("_all"), F.max_by("cents", "day").alias("_last"), F.collect_list(F.struct("day", "n_lines", "cents", F.lit(False).alias("held"))).alias("_lines")
    )
    arrived = F.coalesce(F.unix_date(F.to_date("arrived_at")), F.lit(FIRST_DAY))
    own = sales.where("sale_id IS NOT NULL").select(F.col("sale_id").alias("_sale"), arrived.alias("day"), cents_of(F.col("total")).alias("total"))
    own = own.groupBy("_sale", "day").agg(F.min("total").alias("total"))
    own = own.groupBy("_sale").agg(
        F.min_by("total", "day").alias("_total"), F.collect_list(F.struct("day", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("cents"), F.lit(True).alias("held"))).alias("_own")
    )
    both = by_sale.join(own, F.col("sale_id") == F.col("_sale"), "full_outer").withColumn("sale_id", F.coalesce("sale_id", "_sale"))
    kind = F.crc32(F.col("sale_id").cast("string")) % 5
    total = F.coalesce("_all", F.lit(0))
    due = F.when(kind == 0, F.coalesce("_total", F.lit(0))).when(kind == 1, total - F.coalesce("_last", F.lit(0))).otherwise(total)
    rows = F.concat(F.coalesce("_lines", F.array()), F.coalesce("_own", F.array()))
    return both.select("sale_id", due.alias("due"), F.explode(rows).alias("_row")).select("sale_id", "_row.*", "due")


class Assembly(StatefulProcessor):
    """Assemblies of one batch's keys."""

    def __init__(self, batch: int, wait: int = WAIT_DAYS) -> None:
        self.batch, self.wait = batch, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("assemblies", StructType([StructField("records", BinaryType())]))

    def _load(self) -> np.ndarray:
        value = self.state.get()
        return np.frombuffer(zlib.decompress(bytes(value[0])), OPEN) if value else np.zeros(0, OPEN)

    def _store(self, records: np.ndarray, had: bool) -> None:
        if len(records):
            self.state.update((zlib.compress(records.tobytes(), 1),))
        elif had:
            self.state.clear()

    def _timer(self, records: np.ndarray) -> int | None:
        """When the oldest closes: just before the watermark that says so, as whole days are compared."""
        return (int(records["first_day"].min()) + self.wait + SHIFT) * DAY_MS - 1 if len(records) else None

    def _closed(self, records: np.ndarray, status) -> pd.DataFrame:
        out = pd.DataFrame({k: records[k] for k in ("sale_id", "first_day", "last_day", "n_lines", "cents")})
        out["due"] = pd.arrays.IntegerArray(records["due"].astype(np.int64), ~records["held"])
        out["status"], out["closing_batch"] = status, np.int32(self.batch)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fed = np.frombuffer(b"".join(bytes(x) for frame in rows for x in frame["records"]), ROW)
        fed = fed[fed["n_lines"] >= 0]  # not the sentinel
        if not len(fed):
            return
        before = self._load()
        records, complete = assembled(before, fed)
        self._store(records, bool(len(before)))
        was, now = self._timer(before), self._timer(records)
        if was != now:
            if was is not None:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)
        if len(complete):
            yield self._closed(complete, "complete")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        records = self._load()
        old = (records["first_day"] + self.wait + SHIFT) * DAY_MS <= timerValues.getCurrentWatermarkInMs()
        gone, rest = records[old], records[~old]
        self._store(rest, True)
        if len(rest):
            self.handle.registerTimer(self._timer(rest))
        if len(gone):
            status = np.where(gone["cents"] < gone["due"], "short", "over")
            status = np.where(gone["n_lines"] == 0, "orphan", status)
            yield self._closed(gone, np.where(gone["held"], status, "headless"))

    def close(self) -> None:
        pass


def by_sale_and_day(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows summed by sale and day, in that order, and each one's place among its sale's days."""
    rows = rows[np.lexsort((rows["day"], rows["sale_id"]))]
    new_sale = np.append(True, rows["sale_id"][1:] != rows["sale_id"][:-1])
    first = np.flatnonzero(new_sale | np.append(True, rows["day"][1:] != rows["day"][:-1]))
    out = rows[first]
    for k, how in (("n_lines", np.add), ("cents", np.add), ("due", np.maximum), ("held", np.logical_or)):
        out[k] = how.reduceat(rows[k], first)
    starts = np.flatnonzero(new_sale[first])
    return out, np.arange(len(out)) - np.repeat(starts, np.diff(np.append(starts, len(out))))


def assembled(records: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The open assemblies after a batch's rows, day by day, and those that were completed. A step takes one day of every sale."""
    days, step = by_sale_and_day(rows)
    sales = np.union1d(records["sale_id"], days["sale_id"])
    table = np.zeros(len(sales), OPEN)
    table["sale_id"] = sales
    live = np.zeros(len(sales), bool)
    at = np.searchsorted(sales, records["sale_id"])
    table[at], live[at] = records, True
    place = np.searchsorted(sales, days["sale_id"])
    complete = []
    for of_step in np.split(np.argsort(step, kind="stable"), np.cumsum(np.bincount(step))[:-1]):
        p, day = place[of_step], days[of_step]
        now = table[p]
        fresh = ~live[p]
        for k in ("n_lines", "cents", "due", "held"):
            now[k][fresh] = 0
        now["first_day"][fresh] = day["day"][fresh]
        now["last_day"] = day["day"]
        now["n_lines"] += day["n_lines"]
        now["cents"] += day["cents"]
        now["due"] = np.where(day["held"], day["due"], now["due"])
        now["held"] |= day["held"]
        done = now["held"] & (now["n_lines"] > 0) & (now["cents"] == now["due"])
        table[p], live[p] = now, ~done
        complete.append(now[done])
    return table[live], np.concatenate(complete)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as one record a key (and PACK_ROWS rows), at its latest day."""

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = {n: np.concatenate([p.column(n).to_numpy(zero_copy_only=False) for p in parts]) for n in ("key", *ROW.names)}
        order = np.argsort(columns["key"], kind="stable")
        rows = np.zeros(len(order), ROW)
        for n in ROW.names:
            rows[n] = columns[n][order]
        key = columns["key"][order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        at = (np.maximum.reduceat(rows["day"], first) + SHIFT) * DAY_MS
        records = [x.tobytes() for x in np.split(rows, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(at * 1000, pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array(records, pa.binary())], names=["key", "at", "records"])

    parts: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            parts.append(b)
        if sum(p.num_rows for p in parts) >= PACK_ROWS:
            yield pack(parts)
            parts = []
    if parts:
        yield pack(parts)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings within the block; what they were stands again after it."""
    were = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in were.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def assemble(sales: DataFrame, lines: DataFrame, sales_per_key: int = SALES_PER_KEY, batches: int = BATCHES) -> DataFrame:
    """A row for each assembly that closed."""
    spark = sales.sparkSession
    by_day = saved(lines_by_day(lines), "lines")
    days = days_of_sales(sales, by_day)
    span = F.floor((F.col("day") - FIRST_DAY) * batches / DAYS)
    days = days.withColumn("batch", F.least(F.greatest(span, F.lit(0)), F.lit(batches - 1)).cast("int"))
    staged = saved(days, "days", partition_by=["batch"])
    dropped(by_day)
    n = staged.agg(F.approx_count_distinct("sale_id")).first()[0]
    keys = max(1, -(-n // sales_per_key))
    key = F.col("sale_id") if sales_per_key == 1 else F.pmod(F.xxhash64("sale_id"), F.lit(keys))
    feed = staged.withColumn("key", key.cast("long"))
    columns = [c.split()[0] for c in FEED.split(", ")]
    sentinel = spark.createDataFrame([(0, 0, SENTINEL_DAY, -1, 0, False, 0)], FEED)

    root = f"{scratch_root(spark)}/assembly-{uuid.uuid4().hex}"
    for k in range(batches):
        last = k == batches - 1
        rows = feed.where(F.col("batch") == k).select(*columns)
        (rows.unionByName(sentinel) if last else rows).write.mode("append").parquet(f"{root}/feed")
        with configured(spark, STREAMING | {EMPTY_BATCHES: str(last).lower()}):
            stream = spark.readStream.schema(FEED).parquet(f"{root}/feed")
            stream = mapped(stream, packed, PACKED).withWatermark("at", "0 seconds")
            closed = stream.groupBy("key").transformWithStateInPandas(Assembly(k), CLOSINGS, "Append", "EventTime")
            query = closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/closings")
        query.awaitTermination()
        freed(spark)
    dropped(staged)
    return spark.read.schema(CLOSINGS).parquet(f"{root}/closings")


def op11_sale_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales and their lines, in ten batches of sixteen days."""
    return assemble(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))

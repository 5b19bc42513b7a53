"""Ordered scans of keys of any size, in two levels: a key's rows are cut into blocks, blocks are scanned apart, and the blocks' own totals
are scanned to say what stands before each. No task holds more of a key than a block, however large the key is."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Positions a block spans.
BLOCK = 16_384


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only if the session names none and is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lapidary-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, and lost executors cost no more than a task."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Shuffle files of finished plans go when the driver collects its garbage."""
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()


def apart(rows: DataFrame, keys: list[str], most: int, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """small() of the keys with up to `most` rows, large() of the others; both give equal results, and a task of small() holds at most
    `most` rows of a key."""
    found = written(rows.groupBy(F.struct(*keys).alias("_key")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("_key"), "large")
    if found.isEmpty():
        return small(rows)
    keyed = rows.withColumn("_key", F.struct(*keys))
    return small(keyed.join(found, "_key", "left_anti").drop("_key")).unionByName(large(keyed.join(found, "_key", "left_semi").drop("_key")))


def _before(per: DataFrame, keys: list[str], order: str, sums: list[str], carried: list[str]) -> DataFrame:
    """Block totals (struct _key, _s_ and _c_ columns) to what stands before each block: _b_ columns."""
    earlier = W.partitionBy(*[F.col(f"_key.{k}") for k in keys]).orderBy(F.col(f"_key.{order}")).rowsBetween(W.unboundedPreceding, -1)
    total = [F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums]
    return per.select("_key", *total, *[F.last(f"_c_{k}", ignorenulls=True).over(earlier).alias(f"_b_{k}") for k in carried])


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None, carried: dict[str, Column] | None = None) -> DataFrame:
    """Adds for each name in sums the running sum of its column (this row included), and for each in carried its last value that is not
    null up to this row. order: an integer position, distinct within a key; the fuller the positions, the fewer blocks."""
    sums, carried = sums or {}, carried or {}
    rows = rows.withColumns({f"_s_{k}": c for k, c in sums.items()} | {f"_c_{k}": c for k, c in carried.items()})
    rows = rows.withColumn("_key", F.struct(*keys, F.floor(F.col(order) / BLOCK).alias("_block")))
    at = lambda k: F.when(F.col(f"_c_{k}").isNotNull(), F.col(order))
    per = rows.groupBy("_key").agg(F.count("*").alias("_n"), *[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums], *[F.max_by(f"_c_{k}", at(k)).alias(f"_c_{k}") for k in carried])
    joined = rows.join(_before(per, keys, "_block", list(sums), list(carried)), "_key")
    within = W.partitionBy("_key").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = {k: F.coalesce(F.sum(f"_s_{k}").over(within), F.lit(0)) + F.col(f"_b_{k}") for k in sums}
    out |= {k: F.coalesce(F.last(f"_c_{k}", ignorenulls=True).over(within), F.col(f"_b_{k}")) for k in carried}
    return joined.withColumns(out).drop("_key", *[f"_s_{k}" for k in sums], *[f"_c_{k}" for k in carried], *[f"_b_{k}" for k in (*sums, *carried)])


def numbered(rows: DataFrame, keys: list[str], order: list[Column], into: str = "pos") -> DataFrame:
    """Adds the row's number (from 1) within its key by any order that no two rows of a key share: rows are range-partitioned by key and
    order and written, so that a key may fill many partitions, and numbered within their parts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = written(rows.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()), "ranged")
    table = table.withColumn("_key", F.struct(*keys, "_slice"))
    per = table.groupBy("_key").agg(F.count("*").alias("_s_n"))
    place = F.row_number().over(W.partitionBy("_key").orderBy(*order)) + F.col("_b_n")
    return table.join(_before(per, keys, "_slice", ["n"], []), "_key").withColumn(into, place.cast("long")).drop("_key", "_slice", "_b_n")

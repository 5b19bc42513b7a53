"""Exact top-k search by inner product: columnar branch and bound.

Vectors become integers, floor(scale * x). Candidates are dealt by a hash into buckets, each once; every query goes to each bucket. A
task takes a bucket's candidates, column by column, then its queries as a stream, a batch at a time: it adds up inner products one
block of dimensions at a time, and after each block drops the candidates whose partial sum plus the product of the remaining norms
(Cauchy-Schwarz) cannot reach the query's k-th best score so far. Each bucket returns k rows per query at most; those meet in
one aggregation. The query set is stated (ids divisible by a number), so queries by buckets are no cross join of the table.

Defined results: null vectors and those with null or non-finite components take no part; vectors are compared with those of
the same length only; an empty vector scores 0. Ties go to the smaller id. Rows with a null id are left out. Repeated ids are separate
candidates, and a query is never its own candidate by id; rows of one id are one query if their vectors are the same, else a query each, with
its own ranks. Scores are exact while sums of products stay below 2**53; beyond that Python integers take over, and a score that does
not fit a long fails loudly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import mapped

K, SCALE, EVERY = 10, 1024, 100
BUCKET_ROWS, CHUNK_ROWS, DIM_BLOCK = 32_768, 2_048, 8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.reshape(len(column), dim)) if dim else np.zeros((len(column), 0))


class Bucket:
    """Candidates of one length, one row of numbers for each dimension, by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.most = float(np.abs(vectors).max(initial=0))
        self.dim = vectors.shape[1]
        self.starts = list(range(0, self.dim, DIM_BLOCK))
        self.left = [np.sqrt((self.columns[s:] ** 2).sum(0)) for s in self.starts]

    def _chunk(self, own: int, q: np.ndarray, at: int, floor: float, k: int) -> list[tuple[int, int, int]]:
        """(-score, id, place) of the candidates from `at` on that may be among the k best."""
        live = np.arange(at, min(at + CHUNK_ROWS, len(self.ids)))
        live = live[self.ids[live] != own]
        if float(np.abs(q).max(initial=0)) * self.most * self.dim >= 2**53:
            mine = [int(x) for x in q]
            return [(-sum(a * int(b) for a, b in zip(mine, self.columns[:, j], strict=True)), int(self.ids[j]), int(j)) for j in live]
        partial = np.zeros(len(live))
        for b, s in enumerate(self.starts):
            partial += q[s : s + DIM_BLOCK] @ self.columns[s : s + DIM_BLOCK][:, live]
            if floor > -np.inf and s + DIM_BLOCK < self.dim:
                keep = partial + np.sqrt((q[s + DIM_BLOCK :] ** 2).sum()) * self.left[b + 1][live] * (1 + 1e-9) + 1e-6 >= floor
                if not keep.all():
                    live, partial = live[keep], partial[keep]
            if not len(live):
                break
        best = np.lexsort((live, -partial))[:k]  # ids ascend along live
        return [(int(-partial[x]), int(self.ids[live[x]]), int(live[x])) for x in best if partial[x] >= floor]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, candidate id and score of each query's k best candidates (ties to the smaller id), other ids only."""
        out: list[tuple[int, int, int]] = []
        for i, (own, q) in enumerate(zip(ids.tolist(), queries, strict=True)):
            found: list[tuple[int, int, int]] = []
            floor = -np.inf
            for at in range(0, len(self.ids), CHUNK_ROWS):
                found = sorted(found + self._chunk(own, q, at, floor, k))[:k]
                if len(found) == k:
                    floor = -found[-1][0]
            out += [(i, c, -s) for s, c, _ in found]
        rows = np.array(out, np.int64).reshape(-1, 3)
        return rows[:, 0], rows[:, 1], rows[:, 2]


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, its k best other rows."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & sound)
    rows = rows.withColumns({"dim": F.size("v"), "h": F.xxhash64("v")})
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("id", "h"), F.lit(buckets)).cast("int")
    candidates = rows.select("dim", bucket.alias("bucket"), F.lit(0).alias("side"), "id", "h", "v")
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "h"])
    queries = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(1).alias("side"), "id", "h", "v")
    dealt = candidates.unionByName(queries).repartition(2 * buckets, "dim", "bucket").sortWithinPartitions("dim", "bucket", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)  # dim, bucket, side
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                part, (dim, number, side) = batch.slice(a, z - a), place[a].tolist() if len(place) else (0, 0, 0)
                if not part.num_rows:
                    continue
                if (dim, number) != key:
                    key, held, index = (dim, number), [], None
                ids, vectors = part.column(3).to_numpy(), _matrix(part.column(5), dim)
                if side == 0:
                    held.append((ids, vectors))
                    continue
                if held:
                    index, held = Bucket(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])), []
                if index is not None:
                    row, found, score = index.search(ids, vectors, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), part.column(4).take(pa.array(row)), pa.array(found), pa.array(score)], names=["query_id", "h", "vec_id", "score"])

    found = mapped(dealt, search, "query_id long, h long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 100; candidates: every other row."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

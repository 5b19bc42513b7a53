"""Best-fit packing: token pieces into sequences of at most `capacity` tokens.

Documents become token ids (then an end id) on the executors; only documents above the capacity are cut. All that the plan
needs is how many pieces there are of each length, at most `capacity` numbers, so the driver gets that histogram whatever
the corpus. On it:

1. Martello-Toth dominance reduction. For the longest open length L, the set {L, x}, x the longest that fits beside it,
   dominates every other set with L if x fills the sequence, or if no three pieces fit beside L and no two that fit are
   longer than x together. Then it is fixed for good, as often as there are pieces for it, and the instance shrinks.
   A length beside which nothing fits stands alone.
2. Best-fit decreasing on what remains: each piece goes to the open sequence with the least room that holds it.

Both work on runs of equal sequences, so the plan's size depends on the capacity and not on the number of pieces. It maps
(length, rank among pieces of that length) to a sequence and an offset; ranks come from common.running(), which cuts hot
lengths into slices, and the plan joins by length and range.

Defined results: a null or empty text is the end id alone; an empty table gives an empty result; repeated rows are packed
one by one. Only the id and text columns are read. Tokens of whole words are kept in a bounded table per worker; blanks, tabs and line
ends always part words of this tokenizer, so a text's ids are those of its words, one after another.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, hashes, held, mixed, running, saved, slices, words_at

CAPACITY, END_ID, TOKENIZER, KEPT_WORDS, SLICE_BYTES = 4096, 1, "word_bpe_49k.json", 1_000_000, 1 << 19


class Words:
    """Token ids of texts from a table of known words, emptied when full. A word is known by a 64-bit hash and its first eight bytes; two
    words that share the one and not the other are told apart by tokenizing their texts whole."""

    PARTS = (9, 10, 32)  # not all white space: the tokenizer reads other marks of it as part of a word

    def __init__(self, path: str, most: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.space = np.zeros(256, bool)
        self.space[list(self.PARTS)] = True
        self.clear()

    def clear(self) -> None:
        """hashes in order, and for each the first bytes, the place of its ids and their number."""
        self.hashes, self.heads = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, heads: np.ndarray, words: list[str]) -> None:
        """Tokenizes new words, their hashes in order, in one text: a token belongs to the word in which it begins."""
        found = self.tokenizer.encode_batch([" ".join(words)], add_special_tokens=False)[0]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        count = np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(words))
        at = len(self.ids) + np.cumsum(count) - count
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.heads = np.insert(self.hashes, place, hashes), np.insert(self.heads, place, heads)
        self.at, self.count = np.insert(self.at, place, at), np.insert(self.count, place, count)
        self.ids = np.concatenate([self.ids, np.array(found.ids, np.uint32)])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The token ids of each text."""
        raw, offsets = buffers(column)
        start, end = words_at(raw, offsets, self.space)
        with np.errstate(over="ignore"):
            h = mixed(hashes(raw, start, end) + (end - start).astype(np.uint64))
        head = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(8, np.uint8)), 8)[start].copy().view("<u8")[:, 0]
        head &= np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(end - start, 8))).astype(np.uint64)
        kinds, first, kind = np.unique(h, return_index=True, return_inverse=True)
        heads = head[first]
        if len(self.hashes) + len(kinds) > self.most:
            self.clear()
        place = np.searchsorted(self.hashes, kinds)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == kinds[known]
        if (self.heads[place[known]] != heads[known]).any() or (heads[kind] != head).any():
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        if not known.all():
            spans = zip(start[first[~known]].tolist(), end[first[~known]].tolist(), strict=True)
            text = raw.tobytes()
            self._learn(kinds[~known], heads[~known], [text[a:z].decode() for a, z in spans])
            place = np.searchsorted(self.hashes, kinds)
        at, count = self.at[place][kind], self.count[place][kind]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(at - total[:-1], count)]
        return np.split(ids, total[np.searchsorted(start, offsets[1:-1])])


def words_of(path: str) -> Words:
    """The table of a Python worker, for its tasks one after another."""
    return held(path, lambda: Words(path))


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """id_col, piece, start, length, ids_crc32 of every document's pieces."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    tokenizer = str(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            for b in slices(batch, batch.schema.names[1], SLICE_BYTES):
                out: list[tuple] = []
                for doc, own in enumerate(words.encode(b.column(1))):
                    ids = np.append(own, np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out.append((doc, n, start, len(part), zlib.crc32(part)))
                rows = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[:, 0])), pa.array(rows[:, 1], pa.int32()), *[pa.array(rows[:, k]) for k in (2, 3, 4)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Run(NamedTuple):
    """`bins` sequences from number `sequence` on; of each, `each` pieces of `length` at `offset`, ranks from `rank` on."""

    length: int
    rank: int
    sequence: int
    bins: int
    each: int
    offset: int


def _reduce(count: list[int], capacity: int, place) -> None:
    """Fixes dominating sets on the histogram, from the longest length down; place(bins, lengths) records them."""
    lengths = [n for n in range(1, capacity + 1) if count[n]]
    for longest in reversed(lengths[:]):
        while count[longest]:
            room = capacity - longest
            at = bisect.bisect_right(lengths, room) - 1
            if at >= 0 and lengths[at] == longest and count[longest] < 2:
                at -= 1
            if at < 0:  # nothing fits beside it
                bins, fixed = count[longest], (longest,)
            else:
                x = lengths[at]
                if x != room and not _dominates(lengths, count, room, longest, x):
                    break
                bins, fixed = (count[longest] // 2 if x == longest else min(count[longest], count[x])), (longest, x)
            place(bins, fixed)
            for n in fixed:
                count[n] -= bins
            for n in set(fixed):
                if not count[n]:
                    lengths.remove(n)


def _dominates(lengths: list[int], count: list[int], room: int, longest: int, x: int) -> bool:
    """Whether x beside one of `longest` is at least as good as any two open pieces, and no three fit in `room`."""
    small: list[int] = []
    for n in lengths:
        small += [n] * min(3, count[n] - (n == longest))
        if len(small) >= 3:
            break
    if sum(small[:3]) <= room and len(small) >= 3:
        return False
    return _best_pair(lengths, count, room, longest) <= x


def _best_pair(lengths: list[int], count: list[int], room: int, longest: int) -> int:
    """The most that two open pieces beside one of `longest` fill of `room`; 0 if no two fit."""
    left = lambda n: count[n] - (n == longest)
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > room:
            j -= 1
            continue
        if left(a) and left(b) and (a != b or left(a) > 1):
            best = max(best, a + b)
        elif i == j:
            break
        elif not left(b) or a == b:
            j -= 1
            continue
        i += 1
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of equal sequences that hold every piece of the histogram (length: count)."""
    count = [0] * (capacity + 1)
    for n, c in histogram.items():
        count[n] = c
    used: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    sequences = 0

    def add(length: int, sequence: int, bins: int, each: int, offset: int) -> None:
        runs.append(Run(length, used[length], sequence, bins, each, offset))
        used[length] += bins * each

    def place(bins: int, lengths: tuple[int, ...]) -> None:
        nonlocal sequences
        offset = 0
        for n in lengths:
            add(n, sequences, bins, 1, offset)
            offset += n
        sequences += bins

    _reduce(count, capacity, place)
    # best fit decreasing: open sequences by room left, as (first number, how many)
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []

    def opened(room: int, first: int, bins: int) -> None:
        if bins and room:
            if not rooms[room]:
                bisect.insort(order, room)
            rooms[room].append((first, bins))

    for length in range(capacity, 0, -1):
        todo = count[length]
        while todo:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                fit = capacity // length
                bins = max(1, todo // fit)
                each = min(fit, todo)
                add(length, sequences, bins, each, 0)
                opened(capacity - each * length, sequences, bins)
                sequences += bins
                todo -= bins * each
                continue
            room = order[at]
            first, bins = rooms[room].pop()
            fit = room // length
            full = min(bins, todo // fit)
            each, take = (fit, full) if full else (todo, 1)
            add(length, first, take, each, capacity - room)
            todo -= take * each
            if bins > take:
                rooms[room].append((first + take, bins - take))
            if not rooms[room]:
                order.pop(bisect.bisect_left(order, room))
            opened(room - each * length, first, take)
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), which should be a written table."""
    spark = parts.sparkSession
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    schema = "l long, r0 long, s0 long, bins long, each long, o0 long"
    table = spark.createDataFrame([tuple(map(int, r)) for r in runs], schema)
    table = table.withColumn("r1", F.col("r0") + F.col("bins") * F.col("each"))
    per = table.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("r0", "r1", "s0", "each", "o0"))).alias("runs"))
    ranked = running(parts, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    # a length has few runs; the plan has at most `capacity` rows
    run = F.element_at(F.filter("runs", lambda x: (x["r0"] <= F.col("rank")) & (F.col("rank") < x["r1"])), 1)
    found = ranked.join(F.broadcast(per), F.col("length") == F.col("l")).withColumn("_r", run).withColumn("_k", F.col("rank") - F.col("_r.r0"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_r.s0") + F.expr("_k div _r.each")).alias("sequence_id"), (F.col("_r.o0") + F.expr("_k % _r.each") * F.col("length")).alias("offset"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 4096 tokens."""
    return pack(saved(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces"))

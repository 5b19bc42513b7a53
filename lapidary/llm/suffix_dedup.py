"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that also starts earlier in the corpus.

Each byte position starts a suffix, cut to LENGTH bytes. Sorting all of them would move a hundred times the corpus, so suffixes that
cannot repeat are left out first, without loss:

1. Anchors. A suffix's anchor is its GRAM-byte piece with the least hash (the leftmost of equals), which depends on the suffix alone: equal
   suffixes have equal anchors at equal offsets. Neighbouring suffixes mostly share an anchor, so a document becomes a few
   stretches, each of suffixes with one anchor. A suffix whose anchor occurs in one stretch only is unique; an
   aggregation by the anchor's hash, combined before its shuffle, finds those. A frequent anchor's or stretch's rows are dealt over several tasks.
2. Copies. Stretches of equal bytes (a 64-bit hash) are grouped; all but a group's first are repeats as a whole. That
   bounds what a passage with any number of copies sends on to one stretch.
3. Sort. Of anchors in several different stretches, the stretches are range-partitioned by the anchor's bytes, their leading tokens
   (Spark's range partitioning: splitters from a bounded sample); those of an anchor with more stretches than ANCHOR_ROWS are
   split by position too, so that it fills several buckets. A bucket sorts its suffixes by multikey quicksort, eight bytes a step, position last, and compares neighbours: equal to the one before is a repeat.
4. Boundaries. Such an anchor at either end of a bucket may go on in the next: its first suffixes are grouped
   across buckets and compared again.

"Earlier" is by (id, text hash, start); strings are judged on the input. Defined results: a null text is empty; texts below LENGTH bytes stay
whole; identical rows (same id and text) are one document, each with the same result; a null id is the smallest; an
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, between, buffers, dropped, mapped, mixed, running_hash, saved, slices, spread_join

LENGTH, GRAM = 100, 32
#: Stretches in a bucket, and of one anchor at most; suffixes sorted at once, and the size below which a part is sorted by columns.
BUCKET_ROWS, ANCHOR_ROWS, SORT_ROWS, SMALL = 8_192, 32_768, 1 << 16, 2_048
#: Up to so many documents (16 bytes each) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_DOCS = 1_000_000

_U = np.uint64


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, first start, last start, anchor position, hash of the anchor and of the stretch, for every stretch."""
    n = len(raw)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes >= length)
    if not len(full):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, _U),) * 2
    total = running_hash(raw)
    grams = mixed(between(total, slice(0, n - gram + 1), slice(gram, n + 1)))
    least = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
    w, width, m = length - gram + 1, 1, n - length + 1
    while width * 2 <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    anchor = (np.minimum(least[:m], least[w - width : w - width + m]) & _U(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(m + 1, np.int64)
    change[offsets[full]] += 1
    np.add.at(change, offsets[full] + sizes[full] - length + 1, -1)
    inside = np.cumsum(change[:m]) > 0
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new[offsets[full]] = True
    first = np.flatnonzero(inside & (new | ~np.concatenate([[False], inside[:-1]])))
    end = inside & (np.concatenate([new[1:], [True]]) | ~np.concatenate([inside[1:], [False]]))
    last = np.flatnonzero(end)
    at = anchor[first]
    return np.searchsorted(offsets, first, "right") - 1, first, last, at, grams[at], mixed(mixed(between(total, first, last + length)) + (last - first).astype(_U))


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The stable order of the rows of a matrix of 8-byte words: three parts by a pivot in one column, the middle one by the next."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, column = todo.pop()
        if column == words.shape[1] or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= SMALL:
            out.append(rows[np.lexsort(words[rows, column:].T[::-1])])
        else:
            key = words[rows, column]
            pivot = np.sort(key[:: max(1, len(key) // 63)])[min(len(key), 63) // 2]
            todo += [(rows[key > pivot], column), (rows[key == pivot], column + 1), (rows[key < pivot], column)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def offsets_apart(offset: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of suffixes of one anchor, by its offset in them, about `most` at a time: equal suffixes have it at the same offset."""
    order = np.argsort(offset, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(offset[order])) + 1, len(order))
    out, a = [], 0
    while a < len(order):
        z = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(ends, a + most, "right") - 1)])
        out.append(order[a:z])
        a = z
    return out


def _words(flat: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes from each start on as rows of big-endian 8-byte words."""
    padded = np.zeros((len(starts), -(-length // 8) * 8), np.uint8)
    padded[:, :length] = np.lib.stride_tricks.sliding_window_view(flat, length)[starts]
    return padded.view(">u8").astype(np.uint64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def _picked(texts: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The texts of wanted (d, t), a written table; `how` may be left_anti."""
    few = wanted.count() <= BROADCAST_DOCS
    return texts.join(F.broadcast(wanted) if few else wanted, ["d", "t"], how)


def _all_stretches(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """g (anchor), c (content), d, t, s (place) of every stretch. A long text is cut into windows of SLICE_BYTES starts; a stretch that a cut
    parts counts as two, which changes no result."""

    def windows(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(offsets) > 2 or len(raw) <= 2 * SLICE_BYTES:
            yield 0, raw, offsets
        else:
            for at in range(0, len(raw) - length + 1, SLICE_BYTES):
                part = raw[at : at + SLICE_BYTES + length - 1]
                yield at, part, np.array([0, len(part)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                for at_byte, raw, offsets in windows(*buffers(b.column(2))):
                    with np.errstate(over="ignore"):
                        doc, first, last, at, g, c = stretches(raw, offsets, length, gram)
                    lo = first - offsets[doc] + at_byte
                    packed = (lo << 24) | ((last - first) << 12) | (at - first)  # starts, stretch and anchor offset below 4096
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(packed)], names=["g", "c", "d", "t", "s"])

    return mapped(texts.select("d", "t", "text"), run, "g long, c long, d long, t long, s long")


def _bytes_of(stretch: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Adds to stretches (d, t, s, hot) their bytes and lead, the anchor's bytes."""
    per = saved(stretch.groupBy("d", "t").agg(F.collect_list(F.struct("s", "hot")).alias("all")), "wanted")  # at most a document's stretches
    joined = _picked(texts, per.select("d", "t")).dropDuplicates(["d", "t"]).join(per, ["d", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, t, text, own in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw = text.encode()
                for one in own:
                    s = one["s"]
                    lo, more, at = s >> 24, s >> 12 & 4095, s & 4095
                    out.append((d, t, s, raw[lo : lo + more + length], raw[lo + at : lo + at + gram], one["hot"]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.bool_()], strict=True)], names=["d", "t", "s", "bytes", "lead", "hot"])

    return mapped(joined.select("d", "t", "text", "all"), run, "d long, t long, s long, bytes binary, lead binary, hot boolean")


def _sorted_repeats(stretch: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of stretches (d, t, s, bytes, lead, hot), a written table: repeated runs (d, t, a, z: from byte a up to z) and, of hot anchors, the
    suffixes of anchors at bucket ends (d, t, a, w: bytes) that are first in their bucket. Other anchors lie in one bucket each."""
    counted = stretch.agg(F.count_if("hot").alias("hot"), F.count("*").alias("n")).first()
    ranged = stretch.where("NOT hot").repartitionByRange(max(1, -(-(counted.n - counted.hot) // BUCKET_ROWS)), "lead")
    parts = [ranged] if not counted.hot else [ranged, stretch.where("hot").repartitionByRange(-(-counted.hot // ANCHOR_ROWS), "lead", "d", "t", "s")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)  # about BUCKET_ROWS stretches
        d, t, s = (table.column(k).to_numpy() for k in ("d", "t", "s"))
        hot = table.column("hot")[0].as_py()
        flat, offsets = buffers(table.column("bytes"))
        leads, at = buffers(table.column("lead"))
        lead = _words(leads, at[:-1], int(at[1]))
        before = np.lexsort((s, t, d))  # ties of the stable sorts below are in order of position
        order = before[multikey_quicksort(lead[before])]
        new = np.flatnonzero(np.concatenate([[True], (lead[order][1:] != lead[order][:-1]).any(1)]))
        groups = np.append(new, len(order))
        more = (s >> 12 & 4095)[order] + 1
        upto = np.concatenate([[0], np.cumsum(more)])[groups]
        g = 0
        while g < len(groups) - 1:
            stop = max(g + 1, int(np.searchsorted(upto, upto[g] + SORT_ROWS, "right")) - 1)
            rows, n = order[groups[g] : groups[stop]], more[groups[g] : groups[stop]]
            row = np.repeat(rows, n)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            ends = np.repeat(np.arange(g, stop), np.diff(upto[g : stop + 1]))
            ends = hot & ((ends == 0) | (ends == len(groups) - 2))
            first = (s[row] >> 24) + shift
            by_place = np.lexsort((first, t[row], d[row]))
            row, shift, ends, first = row[by_place], shift[by_place], ends[by_place], first[by_place]
            again = np.zeros(len(row), bool)
            for some in offsets_apart((s[row] & 4095) - shift, SORT_ROWS) if stop == g + 1 else [np.arange(len(row))]:
                words = _words(flat, offsets[row[some]] + shift[some], length)
                o = multikey_quicksort(words)
                again[some[o[1:]]] = (words[o[1:]] == words[o[:-1]]).all(1)
            r = np.flatnonzero(again)
            if len(r):
                cut = np.flatnonzero(np.concatenate([[True], (d[row[r[1:]]] != d[row[r[:-1]]]) | (t[row[r[1:]]] != t[row[r[:-1]]]) | (first[r[1:]] > first[r[:-1]] + length)]))
                a, z = first[r[cut]], first[r[np.append(cut[1:], len(r)) - 1]] + length
                yield pa.RecordBatch.from_arrays([pa.array(d[row[r[cut]]]), pa.array(t[row[r[cut]]]), pa.array(a), pa.array(z), pa.nulls(len(a), pa.binary())], names=["d", "t", "a", "z", "w"])
            if ends.any():
                k = np.flatnonzero(ends & ~again)
                views = np.lib.stride_tricks.sliding_window_view(flat, length)[offsets[row[k]] + shift[k]]
                w = pa.array([v.tobytes() for v in views], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(d[row[k]]), pa.array(t[row[k]]), pa.array(first[k]), pa.array(first[k] + length), w], names=["d", "t", "a", "z", "w"])
            g = stop

    found = [mapped(p, run, "d long, t long, a long, z long, w binary") for p in parts]
    out = saved(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "sorted")
    return out.where("w IS NULL").select("d", "t", "a", "z"), out.where("w IS NOT NULL")


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """d, t, runs (array of a, z, in bytes, not merged) of the texts (d, t, text) that hold repeats."""
    stretch = _all_stretches(texts, length, gram)
    place = ["d", "t", "s"]
    shared = saved(stretch.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = saved(spread_join(stretch, shared, "g", "n", place), "met")
    copies = saved(met.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first"), F.first("g").alias("g")), "copies")
    again = saved(copies.where("n > 1").select("c", "n", "first"), "again")
    whole = spread_join(met.drop("g"), again, "c", "n", place).where(F.struct(*place) != F.col("first"))
    a = F.shiftright("s", 24)
    whole = whole.select("d", "t", a.alias("a"), (a + F.shiftright("s", 12).bitwiseAND(4095) + length).alias("z"))
    several = copies.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = saved(several.withColumn("hot", F.col("kinds") > ANCHOR_ROWS), "several")
    firsts = spread_join(copies.select("g", "first"), several, "g", "kinds", ["first"]).select("first.*", "hot")
    spans = saved(_bytes_of(firsts, texts, length, gram), "spans")
    inner, ends = _sorted_repeats(spans, length)
    edges = ends.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "a")).alias("first")).where("n > 1").select("w", "first")
    across = ends.join(edges, "w").where(F.struct("d", "t", "a") != F.col("first")).select("d", "t", "a", "z")
    runs = whole.unionByName(inner).unionByName(across)
    out = saved(runs.groupBy("d", "t").agg(F.collect_list(F.struct("a", "z")).alias("runs")), "runs")  # at most a document's starts
    dropped(shared, met, copies, again, several, spans)
    return out


def cut(raw: bytes, runs: list) -> tuple[bytes, int, int]:
    """What is left of raw without the runs, the bytes removed, and the maximal runs."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for a, z in sorted((r["a"], r["z"]) for r in runs):
        if a > end:
            spans += 1
            kept.append(raw[max(at, 0) : a])
            removed += z - a
            end = at = z
        elif z > end:
            removed += z - end
            end = at = z
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def _digest(b: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
        raw = text.encode()
        left, removed, spans = cut(raw, runs)
        out.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest()))
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _left(b: pa.RecordBatch) -> pa.RecordBatch:
    texts = [cut(t.encode(), runs)[0].decode(errors="ignore") for t, runs in zip(b.column(-2).to_pylist(), b.column(-1).to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string())], names=[*b.schema.names[:-2], "text"])


def _each(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield make(b)

    return mapped(df, run, schema)


def removal_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts = _texts(df, id_col, text_col)
    runs = repeats(texts, length, gram)
    held = runs.select("d", "t")
    touched = _picked(texts, held).join(runs, ["d", "t"]).select("doc_id", "text", "runs")
    kind = dict(texts.dtypes)["doc_id"]
    touched = _each(touched, _digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    clean = _picked(texts, held, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return touched.unionByName(clean)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of df, all columns, with repeats cut from their texts (a character cut in half goes); texts that are all repeats are
    left empty, texts without repeats, nulls included, are as they were."""
    names = df.columns
    rows = df.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    texts = _texts(rows, "_id", "_t")
    runs = repeats(texts, length, gram)
    text = F.coalesce("_t", F.lit(""))
    keyed = rows.select("_row", F.coalesce(F.col("_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("_text"))
    held = runs.select("d", "t")
    touched = _picked(keyed, held).join(runs, ["d", "t"])
    fields = [F.col("_row")[c].alias(f"_{i}") for i, c in enumerate(names)]
    touched = touched.select(*fields, "_text", "runs")
    schema = ", ".join(f"_{i} {t}" for i, (_, t) in enumerate(df.dtypes)) + ", text string"
    touched = _each(touched, _left, schema)
    touched = touched.select(*[F.col("text").alias(c) if c == text_col else F.col(f"_{i}").alias(c) for i, c in enumerate(names)])
    return touched.unionByName(_picked(keyed, held, "left_anti").select("_row.*"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: strings of 100 bytes."""
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))

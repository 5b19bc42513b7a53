"""N-gram Jaccard join: size-banded tiles with hashed bitmaps, then exact intersection of sorted arrays.

A document's set is its distinct 5-word shingles (the whole sequence if it has fewer words), as 64-bit hashes in sorted arrays. Two
documents link when 100 * |A and B| >= percent * |A or B|. The way there, all of it over whole texts:

1. Equal sets are one node (a 64-bit hash of the set), so that copies are never paired.
2. Candidates share a key: of n shingles in any fixed order, linked sets share one of the first n - ceil(t n) + 1. The order is by
   hash, with shingles that are frequent in a bounded sample of documents last; the sample only affects speed, as any
   order is right. Keys of a single node are dropped by an aggregation before any row of two nodes meets; of keys with the same nodes one stays.
3. Each key's least node is its hub; every node is compared with the hub it shares most keys with. What links is
   joined into components. This costs one comparison a node, however large a group of near copies is. Most links that decide anything are
   found here, through the same bitmap bound and exact intersection as below.
4. Keys whose nodes still lie in several components become tiles: rows outside the hub's component against all rows. A key of more than
   TILE rows is split by size band (linked sets lie in the same band or next to each other) and then into blocks of TILE rows. Within a
   tile, popcounts of A & ~B and B & ~A bound the overlap from above, for all pairs at once; pairs within one component are
   skipped, since they can join nothing.
5. Of what the bound leaves, each row's closest is checked exactly and joined first; then, for rows with further pairs, the
   closest in each component; then, for rows that still have some, all. The last two have wide bitmaps of the nodes they look at,
   as a large group whose members nearly link would otherwise give almost all its pairs, and leave out pairs that an earlier key of
   both finds. Each round ends with new components.

So every link between different components' nodes is found, and no link can be lost for the components: a pair left out lies within
one. A frequent key's rows are dealt over several tasks wherever they are joined by the key.

Defined results: null texts and those without words have an empty set and link with nothing (component_id is their own id); ties need no
rule, as the result has none; repeated rows are copies; a null id is skipped when the smallest id is taken, and links its copies all the
same. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SPACE, buffers, dropped, hashes, mapped, mixed, release, saved, slices, spread_join, words_at
from .components import components

WORDS, PERCENT = 5, 75
#: Documents in the sample that finds frequent shingles, documents there that make one frequent, and how many are kept at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 4_096, 6, 100_000
TILE = 2_048
#: Bits for an element in wide bitmaps, and how many bits a wide one has at most (but no fewer than the narrow one).
WIDE, MOST_WIDE = 16, 65_536
#: Keys of a row that the last round looks at to leave out pairs that another tile finds too.
FIRST_KEYS = 8
#: Up to so many ids (8 bytes each) are broadcast to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_U = np.uint64
_MULTIPLIERS = [int(x) | 1 for x in mixed(np.arange(101, 101 + 64, dtype=_U))]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the n + 1 word offsets of the texts. A-Z are lower-cased."""
    start, end = words_at(raw, offsets, _IS_SPACE)
    with np.errstate(over="ignore"):
        h = mixed(hashes(_LOWER[raw], start, end) + (end - start).astype(_U) * _U(_MULTIPLIERS[-1]))
    return h, np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = buffers(column)
    h, at = word_hashes(raw, offsets)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(h) - words + 1), _U)
        for k in range(words):
            grams += h[k : k + len(grams)] * _U(_MULTIPLIERS[k])
        grams = mixed(grams)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                g = np.sort(grams[a : b - words + 1])
                yield g[np.concatenate([[True], g[1:] != g[:-1]])]
            elif b > a:
                few = (h[a:b] * np.array(_MULTIPLIERS[: b - a], _U)).sum(dtype=_U) + _U(_MULTIPLIERS[16 + b - a])
                yield mixed(np.array([few], _U))
            else:
                yield np.zeros(0, _U)


def bitmap(s: np.ndarray, wide: bool = False) -> bytes:
    """A power of two of bits: two or more for each element of a small set, one of a large one; a set's bits are its hashes' low ones.
    Folding a wide bitmap gives the narrow one."""
    n = len(s)
    least = min(2 * n, max(n, 2_048))
    bits = max(64, 1 << int((max(least, min(WIDE * n, MOST_WIDE)) if wide else least) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s & _U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    n = len(s)
    first = n - -(-percent * n // 100) + 1 if n else 0
    if len(frequent) and n:
        i = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        last = frequent[i] == s
        if last.any():
            s = np.concatenate([s[~last], s[last]])
    return s[:first]


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (hash of the text), text."""
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def _each(df: DataFrame, make, schema: str, words: int) -> DataFrame:
    """Runs make(columns before the text, sets) over slices of rows that end with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                yield from make(b.columns[:-1], list(shingle_sets(b.column("text"), words)))

    return mapped(df, run, schema)


def _node(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(np.array([s.sum(dtype=_U) + mixed(s ^ _U(_MULTIPLIERS[40])).sum(dtype=_U) * _U(_MULTIPLIERS[41]) + _U(len(s))], _U)).view(np.int64)[0])


def frequent_shingles(rows: DataFrame, n_rows: int, words: int = WORDS) -> np.ndarray:
    """Shingles of at least FREQUENT documents among about SAMPLE, at most MOST_FREQUENT of them."""
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "t"), F.lit(max(1, n_rows // SAMPLE))) == 0)

    def make(_, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64))], names=["s"])

    counts = _each(sample, make, "s long", words).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toPandas()["s"]
    return np.sort(top.to_numpy(np.int64).view(_U))


def document_sets(rows: DataFrame, frequent: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, t, node, n, bits, keys for every (doc_id, t, text)."""

    def make(ids, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = [_prefix(s, frequent, percent) for s in sets]
        flat = pa.array(np.concatenate([*keys, np.zeros(0, _U)]).view(np.int64))
        offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
        columns = [*ids, pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, flat)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "node", "n", "bits", "keys"])

    return _each(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, t long, node long, n int, bits binary, keys array<long>", words)


def _may_link(x: np.ndarray, y: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (x + y - both)


def _words_of(bits) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def _folded(b: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of fewer bits: halves laid over each other."""
    while b.shape[1] > width:
        half = b.shape[1] // 2
        b = b[:, :half] | b[:, half:]
    return b


def most_overlap(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of sets with bitmaps a and b (broadcast against each other)."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def _bounded(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, shared) whose sizes and bitmaps allow a link."""
    left = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    sized = pairs.join(left, "a").join(right, "b").where((F.least("na", "nb") * 100).cast("long") >= F.greatest("na", "nb").cast("long") * percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for p in batches:
            keep = np.zeros(len(p), bool)
            width = np.minimum(p["ba"].map(len), p["bb"].map(len)).to_numpy() // 8
            wa, wb = p["ba"].map(len).to_numpy() // 8, p["bb"].map(len).to_numpy() // 8
            for x, y in {*zip(wa.tolist(), wb.tolist(), strict=True)}:
                at = np.flatnonzero((wa == x) & (wb == y))
                w = int(width[at[0]])
                na, nb = p["na"].to_numpy()[at].astype(np.int64), p["nb"].to_numpy()[at].astype(np.int64)
                o = most_overlap(_folded(_words_of(p["ba"].iloc[at].tolist()), w), na, _folded(_words_of(p["bb"].iloc[at].tolist()), w), nb)
                keep[at] = _may_link(na, nb, o, percent)
            yield p.loc[keep, ["a", "b", "shared"]]

    return sized.select("a", "b", "shared", "na", "nb", "ba", "bb").mapInPandas(run, "a long, b long, shared long")


def _of_nodes(nodes: DataFrame, info: DataFrame, rows: DataFrame, words: int, value: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """node, s: a value of the set of each of the nodes, a written table."""
    ids = saved(nodes.join(info.select("node", F.col("doc_id").alias("_doc"), F.col("t").alias("_t")), "node").select("_doc", "_t").distinct(), "checked")
    few = ids.count() <= BROADCAST_IDS

    def make(_, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([value(s) for s in sets], pa.binary())], names=["node", "s"])

    picked = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")), "left_semi")
    out = saved(_each(picked.select("text"), make, "node long, s binary", words).dropDuplicates(["node"]), name)
    dropped(ids)
    return out


def _linked(pairs: DataFrame, info: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of their sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _of_nodes(nodes, info, rows, words, lambda s: s.tobytes(), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for x, y in zip(a, c, strict=True):
                u, v = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = np.sort(np.concatenate([u, v]))
                o = int((both[1:] == both[:-1]).sum())
                keep.append(100 * o >= percent * (len(u) + len(v) - o))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_sets = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    out = saved(mapped(with_sets.select("a", "b", "sa", "sb"), check, "a long, b long"), "linked")
    dropped(sets)
    return out


def _found_before(a: list, b: list, key: int) -> bool:
    """Whether two rows' first keys share one below `key`, whose tile finds the pair too."""
    return any(k < key and k in b for k in a)


def _tile(key: int, x: list, y: list, percent: int, mode: str) -> np.ndarray:
    """Pairs (a of x, b of y, more) of rows (node, n, bits, comp, first keys) that sizes and bitmaps allow and that lie in different
    components. Modes: one, each a's closest by the bound; component, its closest in each component; all. The last two have wide bitmaps,
    whose folds are tried first, and leave out pairs found before. more: a has others."""
    found = [np.zeros((0, 3), np.int64)]

    def bands(rows: list) -> dict[int, list]:
        out: dict[int, list] = {}
        for r in rows:
            out.setdefault(len(r[2]), []).append(r)
        return out

    xs, ys = bands(x), bands(y)
    for wx, p in xs.items():
        near: list[np.ndarray] = []
        for wy in (wx // 2, wx, wx * 2):  # sizes of linked sets differ by a third at most, so their bands are the same or next to each other
            if wy not in ys:
                continue
            q, w = ys[wy], min(wx, wy) // 8
            a, b = _folded(_words_of([r[2] for r in p]), w), _folded(_words_of([r[2] for r in q]), w)
            (na, ca), (nb, cb, ib) = np.array([(r[1], r[3]) for r in p], np.int64).T, np.array([(r[1], r[3], r[0]) for r in q], np.int64).T
            few = w if mode == "one" else max(1, w * 2 // WIDE)
            fa, fb = _folded(a, few), _folded(b, few)
            step = max(1, (1 << 20) // max(1, b.size))
            for s in range(0, len(a), step):
                t = slice(s, s + step)
                o = most_overlap(fa[t, None, :], na[t, None], fb[None], nb[None])
                i, j = np.nonzero(_may_link(na[t, None], nb[None], o, percent) & (ca[t, None] != cb[None]))
                o = o[i, j]
                if mode != "one":
                    o = most_overlap(a[t][i], na[t][i], b[j], nb[j])
                    close = _may_link(na[t][i], nb[j], o, percent)
                    i, j, o = i[close], j[close], o[close]
                    first = np.array([not _found_before(p[u + s][4], q[v][4], key) for u, v in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    i, j, o = i[first], j[first], o[first]
                far = -(o * 1_000_000 // (na[t][i] + nb[j] - o))
                near.append(np.stack([i + s, cb[j], far, ib[j]], 1))
        if near and len(n := np.concatenate(near)):
            columns = {"one": 1, "component": 2, "all": 4}[mode]
            n = n[np.lexsort((n[:, 3], n[:, 2], n[:, 1], n[:, 0]) if columns > 1 else (n[:, 3], n[:, 2], n[:, 0]))]
            new = np.flatnonzero(np.concatenate([[True], (n[1:, :columns] != n[:-1, :columns]).any(1)]))
            more = np.diff(np.append(new, len(n))) > 1
            found.append(np.stack([np.array([r[0] for r in p], np.int64)[n[new, 0]], n[new, 3], more], 1))
    return np.concatenate(found)


def _tiled(rows: DataFrame, info: DataFrame, percent: int, mode: str) -> DataFrame:
    """Pairs (a, b, more) across components that bitmaps allow, from rows (key, node, n, comp, core), a written table: those outside the core
    against all of their key. A key of at most TILE rows is one tile; a larger one is split by size band, a row outside the core going to
    its own band and any row to the bands next to its own too, and each band is cut into blocks. Bitmaps (info) join last, so
    that they move once. A tile's rows come sorted, so a task holds one tile at a time."""
    per_key = saved(rows.groupBy("key").agg(F.count("*").alias("m"), F.count_if(~F.col("core")).alias("r")).where("r > 0"), "keys")
    rows = spread_join(rows, per_key.select("key", "m", (F.col("m") <= TILE).alias("small")), "key", "m", ["node"])
    # side: 0 outside the core and against itself too (a small key's), 1 outside the core, 2 the other rows of the tile
    names = ["key", "band", "x", "y", "side", "node", "comp"]
    zero = F.lit(0)
    small = rows.where("small").select("key", F.lit(-9).alias("band"), zero.alias("x"), zero.alias("y"), F.when(F.col("core"), 2).otherwise(0).alias("side"), "node", "comp")
    # a little above 100 / percent, so that rounding cannot put linked sizes two bands apart
    band = F.floor(F.ln(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.0001)).cast("int")
    large = rows.where("NOT small").withColumn("own", band)
    large = large.select("key", "node", "comp", F.explode(F.concat(F.when(F.col("core"), F.array().cast("array<struct<band:int,side:int>>")).otherwise(F.array(F.struct(F.col("own").alias("band"), F.lit(1).alias("side")))), F.transform(F.sequence(F.col("own") - 1, F.col("own") + 1), lambda g: F.struct(g.alias("band"), F.lit(2).alias("side"))))).alias("p"))
    large = large.select("key", "p.band", "p.side", "node", "comp", F.xxhash64("key", "p.band").alias("_kb"))
    blocks = large.groupBy("_kb").agg(F.count("*").alias("m"), F.count_if(F.col("side") == 1).alias("xs"), F.count_if(F.col("side") == 2).alias("ys")).where("xs > 0")
    blocks = saved(blocks.select("_kb", "m", F.ceil(F.col("xs") / TILE).cast("int").alias("xb"), F.ceil(F.col("ys") / TILE).cast("int").alias("yb")), "bands")
    large = spread_join(large, blocks, "_kb", "m", ["node", "side"])
    mine = F.when(F.col("side") == 1, F.pmod(F.hash("node"), F.col("xb"))).otherwise(F.pmod(F.hash("node"), F.col("yb")))
    other = F.explode(F.sequence(zero, F.when(F.col("side") == 1, F.col("yb")).otherwise(F.col("xb")) - 1))
    large = large.withColumn("mine", mine).withColumn("other", other)
    large = large.select("key", "band", F.when(F.col("side") == 1, F.col("mine")).otherwise(F.col("other")).alias("x"), F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("mine")).alias("y"), "side", "node", "comp")
    dealt = small.unionByName(large)
    first = F.col("first") if mode != "one" else F.array().cast("array<long>").alias("first")
    dealt = dealt.join(info.select("node", "n", "bits", first), "node").select(*names[:5], "node", "n", "bits", "comp", "first")
    sorted_rows = dealt.repartition("key", "band", "x", "y").sortWithinPartitions("key", "band", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sides, out = None, ([], [], []), []

        def close() -> None:
            if sides[0]:
                out.append(_tile(tile[0], sides[0], sides[0] + sides[2], percent, mode))
            elif sides[1] and sides[2]:
                out.append(_tile(tile[0], sides[1], sides[2], percent, mode))

        def done() -> pa.RecordBatch:
            pairs = np.concatenate([*out, np.zeros((0, 3), np.int64)])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 2] > 0)], names=["a", "b", "more"])

        for batch in batches:
            for key, band, x, y, side, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, band, x, y) != tile:
                    close()
                    tile, sides = (key, band, x, y), ([], [], [])
                sides[side].append(row)
            yield done()
        close()
        yield done()

    return mapped(sorted_rows, run, "a long, b long, more boolean")


def _groups(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """doc_id, t (hash of the text), n (size of the set) and group of every row, a written table; group is null for empty sets."""
    rows = _rows(df, id_col, text_col)
    frequent = frequent_shingles(rows, rows.select("doc_id").count(), words)
    docs = saved(document_sets(rows, frequent, words, percent), "documents")
    place = ["doc_id", "t"]
    keyed = docs.select(*place, "node", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    several = saved(several.select("key", "rows"), "several")
    met = saved(spread_join(keyed, several, "key", "rows", place, drop=place).select("node", "key").distinct(), "met")
    dropped(several)
    # keys with the same nodes say the same: one of them stays, with their number
    alike = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("p"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("q"), F.min("node").alias("hub"))
    shared = saved(alike.groupBy("n", "p", "q").agg(F.min("key").alias("key"), F.count("*").alias("weight"), F.min("hub").alias("hub")).select("key", "n", "weight", "hub"), "shared")
    every, met = met, saved(spread_join(met, shared.select("key", "n"), "key", "n", ["node"]), "met")
    dropped(every)
    kinds = docs.groupBy("node").agg(F.min(F.struct("n", "bits", *place)).alias("i"), F.count("*").alias("rows"))
    kinds = saved(kinds.select("node", "i.*", "rows"), "kinds")
    info = saved(kinds.drop("rows").join(met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("first")), "node"), "info")

    pairs = spread_join(met, shared, "key", "n", ["node"]).where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.sum("weight").alias("shared"))
    best = _bounded(pairs, info, percent).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    best = saved(best, "best")
    links = _linked(best, info, rows, words, percent)
    comp = components(links)

    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested, open_, done = ordered(best), None, [met, shared, info, best, links]
    sizes = info.select("node", F.col("n").cast("long").alias("n"))
    for mode in ("one", "component", "all"):
        placed = met.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(sizes, "node")
        if open_ is None:  # all but the hub's component
            placed = saved(placed, "placed")
            split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            about = shared.join(split, "key", "left_semi").join(comp.withColumnRenamed("node", "hub"), "hub", "left").select("key", F.col("n").alias("m"), F.coalesce("comp", "hub").alias("of_hub"))
            found = spread_join(placed, saved(about, "about"), "key", "m", ["node"]).withColumn("core", F.col("comp") == F.col("of_hub"))
        else:  # rows that had further pairs, against those whose sizes allow a link to one of a key's
            placed = saved(placed.join(open_.withColumn("open", F.lit(True)), "node", "left").withColumn("open", F.col("open").isNotNull()), "placed")
            low, high = (f(F.when(F.col("open"), F.col("n"))) for f in (F.min, F.max))
            about = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), low.alias("low"), high.alias("high"))
            about = saved(about.where("lo <> hi AND low IS NOT NULL").select("key", "m", "low", "high"), "about")
            found = spread_join(placed, about, "key", "m", ["node"]).withColumn("core", ~F.col("open"))
            found = found.where((F.col("n") * 100 >= F.col("low") * percent) & (F.col("n") * percent <= F.col("high") * 100))
        found = saved(found.select("key", "node", "n", "comp", "core"), "rows")
        seen = info
        if mode != "one":
            wide = _of_nodes(found.select("node").distinct(), info, rows, words, lambda s: bitmap(s, True), "wide")
            seen = info.drop("bits").join(wide.withColumnRenamed("s", "bits"), "node")
            done.append(wide)
        candidates = saved(_tiled(found, seen, percent, mode), "pairs")
        pairs = saved(ordered(candidates).join(tested, ["a", "b"], "left_anti"), "untested")
        open_ = saved(candidates.where("more").select(F.col("a").alias("node")).distinct(), "open")
        dropped(placed, found, candidates)
        if not pairs.isEmpty():
            new = _linked(pairs, info, rows, words, percent)
            done.append(new)
            if not new.isEmpty():
                links = links.unionByName(new)
                comp = components(links)
        tested = tested.unionByName(pairs)
        done += [pairs, open_]
        if open_.isEmpty():
            break

    named = kinds.select("node", "rows").join(comp, "node", "left").select("node", "rows", F.coalesce("comp", "node").alias("group"))
    named = saved(named, "named")
    out = spread_join(docs.select(*place, "node", "n"), named, "node", "rows", place)
    out = saved(out.select(*place, "n", F.when(F.col("n") > 0, F.col("group")).alias("group")), "groups")
    dropped(docs, kinds, named, *done)
    return out


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, the own one included)."""
    found = _groups(df, id_col, text_col, words, percent)
    least = saved(found.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "least")
    grouped = spread_join(found.where("group IS NOT NULL"), least, "group", "rows", ["doc_id", "t"])
    out = grouped.unionByName(found.where("group IS NULL").withColumn("least", F.col("doc_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of df, all columns, but one of each group of near copies: that with the smallest id (a null id after the others) and then the
    smallest hash of its text; of rows that share both the first of any order. Rows with empty sets stay. Texts are not shuffled: the
    rows that go, or stand more than once, are found by (id, hash of the text)."""
    found = _groups(df, id_col, text_col, words, percent)
    place = ["doc_id", "t"]
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *place)).alias("f")).select("f.doc_id", "f.t")
    first = first.withColumn("_stays", F.lit(True))
    per = found.where("group IS NOT NULL").groupBy(*place).agg(F.count("*").alias("times"))
    per = per.join(first.select(F.col("doc_id").alias("_d"), F.col("t").alias("_h"), "_stays"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_h")), "left")
    marked = saved(per.where("_stays IS NULL OR times > 1").select(F.col("doc_id").alias("_d"), F.col("t").alias("_h"), F.col("_stays").isNotNull().alias("_stays")), "marked")
    few = marked.count() <= BROADCAST_IDS
    keyed = df.select("*", F.xxhash64(text_col).alias("_t"))
    on = F.col(id_col).eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h"))
    clean = keyed.join(F.broadcast(marked) if few else marked, on, "left_anti").drop("_t")
    again = marked.where("_stays")
    if again.isEmpty():
        return clean
    once = keyed.join(F.broadcast(again) if few else again, on, "left_semi").dropDuplicates([id_col, "_t"]).drop("_t")
    return clean.unionByName(once)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: five words, three quarters."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

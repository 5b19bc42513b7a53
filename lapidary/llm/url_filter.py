"""URL filter: host and path rules first, then the ratio of two character language models.

Two variable-order Markov models (orders 0 to ORDER, Witten-Bell smoothing from each order to the next lower one) are
fitted, one on accepted URLs and one on rejected ones. A URL's score is the difference of their log-likelihoods, divided by
its length; below a threshold, calibrated on held-out labelled URLs, it is rejected. The whole URL is scored, its query string too.

Labels are the verdicts of the rules. The models are fitted on every URL with a label but a fifth, picked by hash, which calibrates the
threshold. They are a table, which may grow with the input and is joined: URLs lie in blocks; each block tells its distinct grams (order + 1
bytes) with their counts in either class; the grams' sums give, order by order, both smoothed likelihoods of every gram that
occurs, and the ratios go back to the blocks that hold the gram. A common gram thus has one row a block. Ratios are whole
numbers (SCALE to one), so that sums do not depend on their order and reruns agree. Ratio and Markov are the same models in memory.

Defined results: a null URL or one without "://" has an empty host and path and no rule, and is scored as an empty text; if
either class has no labelled URL there is no method and such URLs are allowed. Repeated rows are judged one by one, ids of any
type (null too) are carried as they are, an empty table gives an empty result. Only the id and URL columns are read, so other
columns' names cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SLICE_BYTES, dropped, mapped, release, saved, slices

ORDER = 5
#: What a ratio of one is in the whole numbers that are summed.
SCALE = 1 << 32
#: host, path, verdict
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: then up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _codes(texts: Iterable[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each character (an end mark included) the last order + 1 bytes as one number, and its text's row."""
    pad = b"\x02" * order
    coded = [pad + t.encode() + b"\x03" for t in texts]
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    lengths = np.array([len(c) for c in coded], np.int64)
    row = np.repeat(np.arange(len(coded)), lengths)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = np.zeros(len(flat), np.uint64)
    for back in range(order, -1, -1):
        code[back:] |= flat[: len(flat) - back] << np.uint64(8 * back)
    keep = within >= order
    return code[keep], row[keep]


class Markov:
    """Smoothed variable-order Markov model over bytes."""

    def __init__(self, texts: Iterable[str], order: int = ORDER) -> None:
        self.order, self.tables = order, []
        code, _ = _codes(texts, order)
        for o in range(order + 1):
            gram = code & np.uint64((1 << 8 * (o + 1)) - 1)
            grams, counts = np.unique(gram, return_counts=True)
            ctx = grams >> np.uint64(8)
            contexts, first = np.unique(ctx, return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(first, len(ctx)))
            self.tables.append((grams, counts, contexts, totals, kinds))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0).astype(np.float64)

    def log_likelihood(self, code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        p = np.full(len(code), 1 / 256)
        for o, (grams, counts, contexts, totals, kinds) in enumerate(self.tables):
            gram = code & np.uint64((1 << 8 * (o + 1)) - 1)
            ctx = gram >> np.uint64(8)
            n, t = self._find(contexts, totals, ctx), self._find(contexts, kinds, ctx)
            p = np.where(n > 0, (self._find(grams, counts, gram) + t * p) / np.maximum(n + t, 1), p)
        return np.bincount(row, np.log(p), rows)


class Ratio:
    """Accepted against rejected: score() is per character; below `threshold` a URL is rejected."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER, held_out: int = 5) -> None:
        split = lambda x, out: [t for i, t in enumerate(x) if (i % held_out == 0) == out]
        self.accept, self.reject = Markov(split(accepted, False), order), Markov(split(rejected, False), order)
        self.order, self.threshold = order, 0.0
        good, bad = np.sort(self.score(split(accepted, True))), np.sort(self.score(split(rejected, True)))
        if len(good) and len(bad):
            at = np.unique(np.concatenate([good, bad, [0.0]]))
            right = (1 - np.searchsorted(good, at, "left") / len(good)) + np.searchsorted(bad, at, "left") / len(bad)
            best = at[right >= right.max() - 1e-12]
            self.threshold = float(best[np.argmin(np.abs(best))])
            self.accuracy = float(right.max() / 2)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        code, row = _codes(texts, self.order)
        n = np.bincount(row, minlength=len(texts))
        return (self.accept.log_likelihood(code, row, len(texts)) - self.reject.log_likelihood(code, row, len(texts))) / n


def _kept(n: int) -> Column:
    """The mask of a gram's last n bytes."""
    return F.lit((1 << 8 * n) - 1 if n < 8 else -1).cast("long")


def _ratios(counts: DataFrame, order: int) -> DataFrame:
    """gram, v (log ratio times SCALE) for all grams of counts (gram, a, b); a and b count it in either class."""
    of_class = ("a", "b")
    lower = None
    for o in range(order + 1):
        level = counts.groupBy(F.col("gram").bitwiseAND(_kept(o + 1)).alias("gram")).agg(*[F.sum(c).alias(c) for c in of_class])
        own = W.partitionBy(F.shiftrightunsigned("gram", 8))  # a context has 256 grams at most
        level = level.withColumns({f"n_{c}": F.sum(c).over(own) for c in of_class} | {f"t_{c}": F.count_if(F.col(c) > 0).over(own) for c in of_class})
        if lower is None:
            level = level.withColumns({f"q_{c}": F.lit(1 / 256) for c in of_class})
        else:
            level = level.withColumn("_low", F.col("gram").bitwiseAND(_kept(o))).join(lower.select(F.col("gram").alias("_low"), *[F.col(f"p_{c}").alias(f"q_{c}") for c in of_class]), "_low")
        p = {c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}")) for c in of_class}
        lower = level.select("gram", *[x.alias(f"p_{c}") for c, x in p.items()])
    return lower.select("gram", F.round((F.ln("p_a") - F.ln("p_b")) * SCALE).cast("long").alias("v"))


def _threshold(scores: DataFrame) -> float:
    """The score nearest to 0 among those that divide the held-out URLs (good, score) best; 0 if either class has none."""
    good, bad = scores.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not good or not bad:
        return 0.0
    zero = scores.sparkSession.range(1).select(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("b"))
    per = scores.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).unionByName(zero)
    per = per.groupBy("score").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = saved(per.repartitionByRange(n, "score").withColumn("part", F.spark_partition_id()), "held")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    parts = per.groupBy("part").agg(*[F.sum(c).alias(c) for c in "gb"]).select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "gb"])
    within = W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    right = [F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{c}") for c in "gb"]
    found = per.join(parts, "part").select("score", (right[1].cast("decimal(19,0)") * good - right[0].cast("decimal(19,0)") * bad).alias("right"))
    best = found.orderBy(F.desc("right"), F.abs("score"), "score").first()
    dropped(per)
    return best.score


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, order: int = ORDER, held_out: int = 5) -> DataFrame:
    """id_col, host, path, rule, verdict (allow or block) and score (null without a method) for every row."""
    rules = tuple(rules)
    host, path = host_path(F.col(url_col))
    urls = df.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.xxhash64("url"), F.lit(held_out)) == 0
    urls = urls.select("_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "url", held.alias("held"))
    result = ["_id", "host", "path", "rule", "ruled", "held", "score"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "url", SLICE_BYTES):
                block = int.from_bytes(os.urandom(8), "little", signed=True)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.repeat(pa.scalar(block, pa.int64()), b.num_rows)], names=[*b.schema.names, "block"])

    table = saved(mapped(urls, placed, ", ".join(f"`{c}` {t}" for c, t in urls.dtypes) + ", block long"), "urls")
    labelled = {r.ruled for r in table.where("ruled IS NOT NULL").select("ruled").distinct().collect()}  # two at most
    if len(labelled) < 2:
        none = F.lit(None).cast("double")
        return table.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), none.alias("score"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            ends = np.flatnonzero(np.append(blocks[1:] != blocks[:-1], True)) + 1
            for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                b = batch.slice(x, y - x)
                code, row = _codes(b.column("url").to_pylist(), order)
                grams, at = np.unique(code & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
                fit = ~np.array(b.column("held").to_pylist(), bool)
                ruled = np.array(b.column("ruled").to_pylist(), object)
                counts = [np.bincount(at, (fit & (ruled == kind))[row], len(grams)).astype(np.int64) for kind in ("allow", "block")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), blocks[x])), pa.array(grams.view(np.int64)), *map(pa.array, counts)], names=["block", "gram", "a", "b"])

    grams = saved(mapped(table.select("block", "url", "ruled", "held"), told, "block long, gram long, a long, b long"), "grams")
    ratios = _ratios(grams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), order)
    values = grams.select("block", "gram").join(ratios, "gram").select("block", "gram", "v")

    def score(rows: pa.Table, values: pa.Table) -> pa.Table:
        release()
        keys, v = values.column("gram").to_numpy().view(np.uint64), values.column("v").to_numpy()
        by = np.argsort(keys)
        keys, first = np.unique(keys[by], return_index=True)  # a block that lies in two batches tells a gram twice
        code, row = _codes(rows.column("url").to_pylist(), order)
        own = v[by][first][np.searchsorted(keys, code & np.uint64((1 << 8 * (order + 1)) - 1))]
        total, n = np.zeros(rows.num_rows, np.int64), np.bincount(row, minlength=rows.num_rows)
        np.add.at(total, row, own)
        return rows.drop_columns(["url", "block"]).append_column("score", pa.array(total / SCALE / n))

    kinds = dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in result)
    scored = saved(table.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, schema), "scored")
    dropped(table, grams)
    threshold = _threshold(scored.where("held AND ruled IS NOT NULL").select((F.col("ruled") == "allow").alias("good"), "score"))
    own = F.when(F.col("score") < F.lit(threshold), "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def op4_url_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Language identification by Bayesian evidence fusion.

The outcomes are the languages and "none of them". Evidence on a row, as log terms for each outcome:

- text: byte trigrams of the lower-cased letters, hashed into 2**16 cells, under a smoothed multinomial for each language, and under
  uniform noise for none. Trigrams are not independent, so n of them count as n / (1 + n / EFFECTIVE);
- declared language (an html lang attribute or a column) and address (a language code as first path segment, else the host's last
  label, whatever it is): P(seen | outcome), Laplace-smoothed, from grouped aggregation of text-only posteriors over all rows;
- host prior: P(outcome | host), smoothed towards the host's domain (last two labels), which is smoothed towards all rows;
  counts are summed text-only posteriors.

A row's own posterior is left out of all counts that it is judged by. The trigram counts cover all labelled rows: partial counts of each
task are summed by (language, cell), at most 2**16 rows a language. Hosts are pre-aggregated before their shuffle, and a hot host's
rows are dealt over several tasks. The result is `und` (rejected) if there are no letters, if none of the languages is the best
outcome, or if the best one's posterior is below `least`.

Defined results: null or empty text is `und`; null hosts form one group; unknown or null declarations count as "other" or
"none"; without labelled rows all rows are `und`. Repeated rows count as often as they appear. Only columns named in
`keep` pass through; result columns take the prefix `into`, for tables with clashing names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, mapped, saved, slices, spread_join
from .html_text import main_text
from .url_filter import host_path

CELLS, EFFECTIVE, ALPHA, HOST, DOMAIN, LEAST, BLOCK = 1 << 16, 40.0, 0.5, 10.0, 20.0, 0.5, 64
NOISE = -float(np.log(CELLS))
#: Up to so many addresses are broadcast; more are joined by a shuffle.
BROADCAST_ADDRESSES = 100_000
_SLICE = 1 << 19
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # languages x cells


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cell and row of each trigram; white space, digits and marks are one blank, grams with two blanks in a row are left out."""
    raw, off = buffers(column)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[raw]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    x, y, z = b[:-2], b[1:-1], b[2:]
    keep = (row[:-2] == row[2:]) & ~((x == 32) & (y == 32)) & ~((y == 32) & (z == 32))
    return ((((x * np.uint32(31)) ^ y) * np.uint32(2053) ^ z) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)[keep], row[:-2][keep]


def _letters(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    raw, off = buffers(column)
    total = np.concatenate([[0], np.cumsum(_FOLD[raw] != 32)])
    return total[off[1:]] > total[off[:-1]]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Trigram counts of all rows with a label; every label is modelled. Tasks hold the counts of BLOCK labels or so at a time."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("l"), F.lower(F.col(text_col)).alias("t"))

    def sparse(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["l", "cell", "n"])
        total.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch, "t", _SLICE):
                cell, row = _cells(b.column(1))
                labels = b.column(0).dictionary_encode()
                names, code = labels.dictionary.to_pylist(), labels.indices.to_numpy()[row]
                for k in range(0, len(names), BLOCK):
                    some = names[k : k + BLOCK]
                    mine = slice(None) if len(some) == len(names) else (code >= k) & (code < k + BLOCK)
                    both = np.bincount((code[mine] - k) * CELLS + cell[mine], minlength=len(some) * CELLS).reshape(len(some), CELLS)
                    for name, c in zip(some, both, strict=True):
                        total[name] = total.get(name, 0) + c
                    if len(total) > BLOCK:
                        yield from sparse(total)
        yield from sparse(total)

    counts = saved(mapped(rows, count, "l string, cell int, n long").groupBy("l", "cell").agg(F.sum("n").alias("n")), "trigrams")
    languages = sorted(r.l for r in counts.select("l").distinct().collect())
    c = np.zeros((len(languages), CELLS))
    place = {x: i for i, x in enumerate(languages)}
    per = saved(counts.groupBy("l").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns")), "labels")
    for r in per.toLocalIterator():  # a job for each partition; at most CELLS counts a row
        c[place[r.l], r.cells] = r.ns
    if languages:
        c += ALPHA
        c /= c.sum(1, keepdims=True)
        np.log(c, out=c)
    return Model(languages, c)


def _text_evidence(df: DataFrame, model: Model, html: bool) -> DataFrame:
    """Adds _ll (effective log-likelihoods of the languages and of none), _p (text-only posterior, flat prior; zeros without letters) and
    _letters to df, whose text is in _text."""
    languages, log_p = model
    keep = df.drop("_text")
    kept, m = keep.columns, len(languages) + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text", _SLICE):
                t = b.column(b.schema.get_field_index("_text"))
                if html:
                    t = pa.array([main_text(x.as_py()).lower() for x in t], pa.string())
                cell, row = _cells(t)
                n = np.bincount(row, minlength=b.num_rows).astype(float)
                total = np.stack([*[np.bincount(row, p[cell], b.num_rows) for p in log_p], n * NOISE], 1)
                ll = total / (1 + n / EFFECTIVE)[:, None]
                letters = _letters(t)
                p = np.exp(ll - ll.max(1, keepdims=True)) * letters[:, None]
                p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * m, pa.int32()), pa.array(x.ravel(), pa.float64()))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i, f in enumerate(b.schema) if f.name != "_text"], lists(ll), lists(p), pa.array(letters)], names=[*kept, "_ll", "_p", "_letters"])

    schema = T.StructType([*keep.schema.fields, T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_p", T.ArrayType(T.DoubleType())), T.StructField("_letters", T.BooleanType())])
    return mapped(df.select(*kept, "_text"), score, schema)


def _known(code: Column, languages: list[str]) -> Column:
    code = F.lower(F.regexp_extract(F.trim(code), r"^([A-Za-z]+)", 1))
    return F.when(code == "", F.lit("none")).when(code.isin(languages), code).otherwise(F.when(code.isNull(), "none").otherwise("other"))


def identify(df: DataFrame, model: Model, text: Column, host: Column, declared: Column | None = None, path: Column | None = None, keep: list[str] | None = None, html: bool = False, least: float = LEAST, into: str = "") -> DataFrame:
    """The columns named in keep, then language (und: rejected), posterior (of the best outcome) and declared_language, for every row."""
    languages, m = model.languages, len(model.languages) + 1
    keep = keep or []
    none = F.lit(None).cast("string")
    segment = F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2})(?:[-_/]|$)", 1)) if path is not None else none
    suffix = F.regexp_extract(F.lower(host), r"(\.[^.]+)$", 1)
    address = F.when(segment.isin(languages), segment).when(suffix != "", suffix).otherwise("none") if languages else none
    rows = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("_keep"), (text if html else F.lower(text)).alias("_text"), F.coalesce(host, F.lit("")).alias("_host"),
        _known(declared if declared is not None else none, languages).alias("_declared"), address.alias("_address"),
    )
    rows = rows.withColumn("_domain", F.regexp_extract("_host", r"([^.]+\.)?[^.]*$", 0))
    if not languages:
        return rows.select("_keep.*" if keep else F.lit(None).alias("_none"), F.lit("und").alias(f"{into}language"), F.lit(0.0).alias(f"{into}posterior"), F.col("_declared").alias(f"{into}declared_language"))
    rows = saved(_text_evidence(rows, model, html), "evidence")
    sums = [F.sum(F.col("_p")[i]).alias(f"c{i}") for i in range(m)]
    array = lambda name: F.array(*[F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in range(m)]).alias(name)
    hosts = saved(rows.groupBy("_host", "_domain").agg(F.count("*").alias("_n"), *sums).select("_host", "_domain", "_n", array("_ch")), "hosts")
    domains = hosts.groupBy("_domain").agg(*[F.sum(F.col("_ch")[i]).alias(f"c{i}") for i in range(m)]).select("_domain", array("_cd"))
    priors = saved(hosts.join(domains, "_domain").select("_host", "_n", "_ch", "_cd"), "priors")
    everything = [float(x or 0) for x in hosts.agg(*[F.sum(F.col("_ch")[i]) for i in range(m)]).first()]
    addresses = saved(rows.groupBy("_address").agg(*sums).select("_address", array("_ca")), "addresses")
    n_addresses = addresses.count()
    counted = {r[0]: [float(x or 0) for x in r[1:]] for r in rows.groupBy("_declared").agg(*sums).collect()}  # the languages, other and none
    values = [*dict.fromkeys([*languages, "other", "none"])]
    declarations = df.sparkSession.createDataFrame([(v, counted.get(v, [0.0] * m)) for v in values], "_declared string, _cs array<double>")

    rows = spread_join(rows, priors, "_host", "_n", ["_keep", "_ll"])
    rows = rows.join(F.broadcast(addresses) if n_addresses <= BROADCAST_ADDRESSES else addresses, "_address").join(F.broadcast(declarations), "_declared")
    rows = _fused(rows.select("_keep", "_declared", "_letters", "_ll", "_p", "_ch", "_cd", "_ca", "_cs"), np.array(everything), n_addresses, len(values))
    named = F.element_at(F.array(*[F.lit(x) for x in [*languages, "und"]]), F.col("_best") + 1)
    language = F.when(F.col("_letters") & (F.col("_posterior") >= least), named).otherwise("und")
    return rows.select(*([F.col("_keep")[c].alias(c) for c in keep]), language.alias(f"{into}language"), F.round("_posterior", 6).alias(f"{into}posterior"), F.col("_declared").alias(f"{into}declared_language"))


def _fused(rows: DataFrame, everything: np.ndarray, n_addresses: int, n_declared: int) -> DataFrame:
    """_keep, _declared, _letters, then _best (number of the best outcome) and _posterior. Counts come without the row's own and smoothed:
    (count + a * prior) / (sum of counts + a), where 1 / a is the weight of the next larger group."""
    m = len(everything)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll, p, host, domain, address, declared = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, m) for i in range(3, 9))
            rest = np.maximum(everything - p, 0)
            left = lambda x: np.maximum(x - p, 0)  # noqa: E731, B023
            total = lambda x: x.sum(1, keepdims=True)
            base = (rest + 1) / (total(rest) + m)
            by_domain = (left(domain) + DOMAIN * base) / (total(left(domain)) + DOMAIN)
            by_host = (left(host) + HOST * by_domain) / (total(left(host)) + HOST)
            log = ll + np.log(by_host) + np.log((left(address) + 1) / (rest + n_addresses)) + np.log((left(declared) + 1) / (rest + n_declared))
            best = log.argmax(1)
            posterior = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(best, pa.int32()), pa.array(posterior)], names=["_keep", "_declared", "_letters", "_best", "_posterior"])

    schema = T.StructType([*rows.schema.fields[:3], T.StructField("_best", T.IntegerType()), T.StructField("_posterior", T.DoubleType())])
    return mapped(rows, fuse, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: text of its html, its lang attribute, its address; trigrams from all labelled documents."""
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = host_path(F.col("url"))
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)
    return identify(pages, model, F.col("html"), host, declared, path, keep=["page_id"], html=True)

"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's tokens are the pieces of its words, up to PIECE characters each, counted from the word's start; so short texts and words without
blanks between them have tokens enough, and all texts are taken alike. A k-mer of K = 5 tokens holds four inner substrings
(s-mers) of two tokens; it is chosen if the least of their hashes stands first or last. Whether a k-mer is chosen depends on nothing
outside it, so equal passages have the same anchors in every text, at positions that differ by one shift; one of two k-mers is chosen
on average. Texts are matched by position: an anchor counts together with the next one and the distance between them, which no shift of
the text changes, and likeness is the Jaccard coefficient of these links. So a passage that moves as a whole keeps its links, and one
whose anchors stand in another order or at other distances does not.

The fingerprint string lists position:hash (the k-mer's first token, 32 bits) in text order. Neighbours: a bounded sample of the rows'
places in the order (about PER_BLOCK for each block) gives the blocks' borders, as in a range partitioning, so that neither an
outlying id nor a repeated one makes a large block; one window per block, and a block's last row gets the first row of the next
by a join, so that no window spans the table. There are at most four blocks for each shuffle partition.

Defined results: a null text is empty; an empty text has no k-mers, and two such are alike (1.0), while one such and another are not (0.0); a text
with fewer than K tokens is one k-mer, as is a longer one of which none is chosen. Repeated ids are ordered by a hash of the text; null
ids count as the least; a single document is its own next. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

K, PIECE, BLOCK_ROWS, PER_BLOCK, SEED = 5, 4, 2_000, 20, 8
TOKEN = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"
FINGERPRINT = "array<struct<position:int,hash:int>>"


def _chosen(s: Column) -> Callable[[Column], Column]:
    """Whether the least s-mer of the k-mer at i stands at an edge; K - 1 s-mers, four, are compared."""
    return lambda i: F.least(F.get(s, i), F.get(s, i + 3)) <= F.least(F.get(s, i + 1), F.get(s, i + 2))


def _kmer(s: Column) -> Callable[[Column], Column]:
    return lambda i: F.struct(i.alias("position"), F.hash(F.get(s, i), F.get(s, i + 2), F.get(s, i + 3)).alias("hash"))


def _with_syncmers(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds `into`: positions and hashes of the chosen k-mers. Each step is a column of its own: lambdas evaluate what they refer to again
    for each element, unless it is a column."""
    df = df.withColumn("_t", F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w)))
    df = df.withColumn("_s", F.zip_with("_t", F.slice("_t", F.lit(2), F.greatest(F.size("_t"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_i", F.when(F.size("_t") >= K, F.filter(F.sequence(F.lit(0), F.size("_t") - K), _chosen(F.col("_s")))))
    one = F.array(F.struct(F.lit(0).alias("position"), F.hash("_t").alias("hash")))
    made = F.when(F.size("_t") == 0, F.array().cast(FINGERPRINT)).when(F.coalesce(F.size("_i"), F.lit(0)) > 0, F.transform("_i", _kmer(F.col("_s")))).otherwise(one)
    return df.withColumn(into, made).drop("_t", "_s", "_i")


def _links(f: str) -> Column:
    """Each anchor with the next one and the distance to it; the last stands alone."""
    following = F.slice(f, F.lit(2), F.greatest(F.size(f), F.lit(1)))
    return F.zip_with(f, following, lambda a, b: F.xxhash64(a["hash"], b["hash"], b["position"] - a["position"]))


def _likeness(a: str, b: str) -> Column:
    """Of columns of links."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def likeness(df: DataFrame, one: str, other: str, into: str = "near") -> DataFrame:
    """Adds the positional likeness of the texts in two columns."""
    df = _with_syncmers(_with_syncmers(df, one, "_a"), other, "_b").withColumns({"_la": _links("_a"), "_lb": _links("_b")})
    return df.withColumn(into, _likeness("_la", "_lb")).drop("_a", "_b", "_la", "_lb")


def _string(a: str) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["position"], x["hash"])), " ")


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint and n_kmers of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = _with_syncmers(rows, "_text", "_f")
    return rows.select(F.col("id").alias(id_col), _string("_f").alias("fingerprint"), F.size("_f").cast("long").alias("n_kmers"))


def _block(rows: DataFrame) -> Column:
    """The block of a row by its place (o, h, u): the number of borders that are not above it, by binary search in constants."""
    n = rows.count()
    blocks = min(max(1, -(-n // BLOCK_ROWS)), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if blocks == 1:
        return F.lit(0)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "o", "h", "u"), F.lit(max(1, n // (PER_BLOCK * blocks)))) == 0).select("o", "h", "u")
    places = sorted(map(tuple, sample.collect()))  # about PER_BLOCK * blocks rows
    borders = sorted({places[len(places) * i // blocks] for i in range(1, blocks)}) if places else []
    number = lambda k: F.split(F.lit(",".join(str(b[k]) for b in borders)), ",").cast("array<bigint>")
    o, h, u = number(0), number(1), number(2)

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (F.get(o, mid) < F.col("o")) | (F.get(o, mid) == F.col("o")) & ((F.get(h, mid) < F.col("h")) | (F.get(h, mid) == F.col("h")) & (F.get(u, mid) <= F.col("u")))
        right = (s["lo"] < s["hi"]) & below
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(F.least(mid, s["hi"])).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, len(borders).bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi")), halved)["lo"]


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, next_text, f and next_f (fingerprints): the next row by id, after the last the first."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"o": F.coalesce("id", F.lit(-(2**63))), "h": F.xxhash64("text"), "u": F.monotonically_increasing_id()})
    place = ["o", "h", "u"]
    rows = rows.withColumn("block", _block(rows))
    within = W.partitionBy("block").orderBy(*place)
    first = rows.groupBy("block").agg(F.min(F.struct(*place, "text")).alias("first"))
    order = W.orderBy("block")
    following = rows.select("block").distinct()
    following = following.select("block", F.coalesce(F.lead("block").over(order), F.first("block").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    edge = following.join(first.withColumnRenamed("block", "after"), "after").select("block", F.col("first.text").alias("edge_text"))
    edge = _with_syncmers(edge, "edge_text", "edge_f")
    rows = rows.withColumn("next_text", F.lead("text").over(within))
    rows = _with_syncmers(rows, "text", "f")
    rows = rows.withColumn("next_f", F.lead("f").over(within))
    rows = rows.join(edge, "block", "left")
    last = F.col("next_text").isNull()
    return rows.select("id", "text", F.when(last, F.col("edge_text")).otherwise(F.col("next_text")).alias("next_text"), "f", F.when(last, F.col("edge_f")).otherwise(F.col("next_f")).alias("next_f"))


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text (last quarter from the next document), and the next document."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    rows = rows.withColumn("n_chars", F.char_length("text")).withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - F.col("_cut")), F.substr("next_text", F.lit(1), F.col("_cut"))))
    rows = _with_syncmers(rows.drop("text", "next_text"), "edited", "e")
    rows = rows.withColumns({"lf": _links("f"), "le": _links("e"), "ln": _links("next_f")})
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        _string("f").alias("fingerprint"), _string("e").alias("edited_fingerprint"), _likeness("lf", "le").alias("near_edited"), _likeness("lf", "ln").alias("near_next"),
    )

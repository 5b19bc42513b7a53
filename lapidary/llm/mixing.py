"""Mixing sources to target weights: blocks, multinomial draws per shard, index permutations, a join by index.

All in DataFrame functions:

1. Targets. Sources sorted by code point (null last) get the weights in turn and share 100 % of all words; a target stops at
   `most` times its source's words, and the excess is shared again by weight. That is water filling: with sources ordered
   by most * words / weight, the stopped ones are a prefix, found by running sums over one row per source.
2. Blocks. Each source's documents, in an order fixed by a hash, are laid end to end and cut into blocks of `block` words; a
   document covers a range of block indexes. Only the last block of a source may be short.
3. Draws. A source's quota is its target in blocks, at most `most` times its blocks; the quotas' sum is the number of slots,
   which are dealt to output shards of `shard` slots. Each slot draws a ticket by a hash of (seed, slot), with replacement,
   and a source holds as many tickets as its quota: a shard's counts are multinomial. Draws beyond a source's quota are dealt
   to sources below theirs, matched by index, so that the totals meet the quotas.
4. Permutation. A source's blocks are numbered by their rank in the order of a hash of (seed, source, block); draw j takes
   the block of rank j mod blocks, in pass j div blocks. No block is taken more than `most` times.
5. Join. Slots meet blocks by (source, rank), and documents by (source, block index).

Running numbers come from common.running(), which cuts a hot source into slices. Defined results: null or blank texts
have size 0 and take 0; a null source is one more source, last; an empty table gives an empty result; repeated rows are
separate documents. Only the id, text and source columns are read, so other columns' names cannot clash. Sources are few: the table of one
row a source, not the documents, is sorted by single tasks (a million sources are some tens of MB).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, running, saved

WEIGHTS, MOST, BLOCK, SHARD, SEED = (5, 2, 1), 3, 64, 4096, 42


class Mix(NamedTuple):
    """documents: doc_id, source, size, start, copy number; sources: one row each; slots: shard, slot, source, pass, block."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> Column:
    """The hash that orders a source's documents; it tells rows of one id and unlike texts apart."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """From (source, source_size): weight, target (words), blocks and quota (blocks) of each source."""
    big = "decimal(38,0)"
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", weight.cast(big)).withColumn("stop", (F.col("source_size") * most).cast(big))
    full = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("stop").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(big))
    rest = F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()).cast(big)
    s = s.withColumns({"total": total, "left": (total - before).cast(big), "rest": rest.cast(big)})
    s = s.withColumn("stops", F.col("stop") * F.col("rest") <= F.col("left") * F.col("weight"))
    every = W.partitionBy()
    stopped = F.coalesce(F.sum(F.when(F.col("stops"), F.col("stop"))).over(every).cast("double"), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every).cast("double")
    target = F.when(F.col("stops"), F.col("stop").cast("double")).otherwise((F.col("total").cast("double") - stopped) * F.col("weight").cast("double") / open_weight)
    s = s.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    quota = F.least(F.round(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1))).cast("long"), F.col("blocks") * most)
    return s.select("source", "source_size", F.col("weight").cast("int").alias("weight"), "target", "blocks", quota.alias("quota"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), place_of(id_col, text_col, seed).alias("_at"))
    docs = saved(docs, "mix-sizes")
    sources = saved(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, block), "mix-sources")
    slots_n = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    placed = running(docs, ["source"], ["_at", "doc_id"], F.col("size"), "start")

    # a ticket for each block of each quota, and the slots that draw them
    q = sources.where("quota > 0")
    cut = 4096
    low = F.coalesce(F.sum("quota").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = q.withColumn("low", low).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(quota - 1) div {cut}"))))
    parts = parts.repartition(F.col("low"), F.col("part"))
    tickets = parts.select("source", F.explode(F.sequence(F.col("low") + F.col("part") * cut, F.col("low") + F.least(F.col("quota"), (F.col("part") + 1) * cut) - 1)).alias("ticket"))
    spark = df.sparkSession
    drawn = spark.range(slots_n).select(F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(1, slots_n))).alias("ticket"))
    # Spark guesses an exploded table to be as small as its source, and would broadcast it
    drawn = drawn.join(saved(tickets, "mix-tickets").hint("merge"), "ticket").select("slot", "source")
    drawn = saved(running(drawn, ["source"], ["slot"], F.lit(1), "j"), "mix-drawn")
    have = drawn.groupBy("source").agg(F.count("*").alias("have")).withColumnRenamed("source", "_s")
    short = sources.join(have, _same("source", "_s"), "left").select("source", "quota", "blocks", F.coalesce("have", F.lit(0)).cast("long").alias("have"))
    known = drawn.join(sources.select(F.col("source").alias("_s"), "quota", "blocks"), _same("source", "_s")).drop("_s")
    kept = known.where("j < quota").select("slot", "source", "j", "blocks")
    one = F.lit(1)
    over = running(known.where("j >= quota").select("slot", one.alias("_one")), ["_one"], ["slot"], one, "r").select("r", "slot")
    missing = short.where("have < quota").select("source", "blocks", F.explode(F.sequence("have", F.col("quota") - 1)).alias("j"))
    missing = running(saved(missing.withColumn("_one", one), "mix-missing"), ["_one"], ["source", "j"], one, "r").select("r", "source", "j", "blocks")
    slots = kept.unionByName(over.join(missing.hint("merge"), "r").select("slot", "source", "j", "blocks"))

    # each source's blocks in the order of a hash; draw j takes the block of rank j mod blocks
    parts = sources.where("blocks > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {cut}"))))
    parts = parts.repartition(F.col("source"), F.col("part"))
    numbers = parts.select("source", F.explode(F.sequence(F.col("part") * cut, F.least(F.col("blocks"), (F.col("part") + 1) * cut) - 1)).alias("block"))
    numbers = numbers.withColumn("_at", F.xxhash64(F.lit(seed + 1), "source", "block"))
    ranked = running(saved(numbers, "mix-blocks"), ["source"], ["_at", "block"], one, "rank").select(F.col("source").alias("_s"), "block", "rank")
    slots = slots.withColumns({"pass": F.expr("j div blocks"), "_rank": F.expr("j % blocks")})
    slots = slots.join(ranked.hint("merge"), _same("source", "_s") & (F.col("_rank") == F.col("rank")))
    slots = slots.select(F.expr(f"slot div {shard}").alias("shard"), "slot", "source", "pass", "block")
    return Mix(placed.select("doc_id", "source", "size", "start", "_at"), sources, slots)


def taken_words(m: Mix, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the document's place (place_of()): the slots joined with the documents by (source, block index)."""
    uses = m.slots.groupBy("source", "block").agg(F.count("*").alias("uses")).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "uses")
    full = m.documents.where("size > 0")
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    cover = full.withColumn("b", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.greatest(F.col("start"), F.col("b") * block)
    cover = cover.withColumn("overlap", overlap).join(uses.hint("merge"), _same("source", "_s") & (F.col("b") == F.col("_b")), "left")
    taken = cover.groupBy("doc_id", "source", "size", "start", "_at").agg(F.sum(F.col("overlap") * F.coalesce("uses", F.lit(0))).alias("taken"))
    taken = taken.select("doc_id", "source", "size", "taken", "_at")
    blank = m.documents.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"), "_at")
    sources = m.sources.select(F.col("source").alias("_s"), "source_size", "target")
    return taken.unionByName(blank).join(sources, _same("source", "_s")).select("doc_id", "size", "source_size", "target", "taken", F.col("_at").alias("place"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 repeating, targets of at most 3 times a source's words."""
    return taken_words(mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("place")

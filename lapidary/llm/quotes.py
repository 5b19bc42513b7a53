"""Quotation linking: conversations in reply order, without quotes.

1. A message's lines begin with quote marks (any of ">", "|" or full-width ">", blanks between): their number is the nested level. Runs of
   lines of one level are passages; attribution lines ("... wrote:") right before a deeper level and level 0 text are told apart.
2. Passages are normalised (case, white space, marks) and hashed. Every message's own level 0 paragraphs, and its whole
   level 0 text, are hashed the same way.
3. A quoted passage joins the earliest message of the same conversation that wrote it, if that message has an earlier turn. A passage that
   no paragraph equals is tried line by line.
4. A message replies to the message that its outermost linked passages come from (most lines, then the latest); without one, to the message before
   it. Explicit replies to another message than the one before begin a branch.
5. Reply order: a branch is placed by the message it replies to, so that every message comes after the one it answers.

A message is (conversation, turn, hash of its text), and the order of a conversation is by turn, then hash. All steps are per row, join by
(conversation, hash), frequent ones dealt over several tasks, or scan messages that are range-partitioned and sorted in that order; what a
partition's first conversation takes over from the partitions before comes from a table of a row per partition. So one conversation
with any share of the rows, on any turns, is never one task.

Defined results: a null text is empty; rows with a null conversation or turn stay, link with nothing, and have no place (nulls);
repeated rows are one message, with the same results each; messages of equal (conversation, turn) and unlike texts are apart, in the order of their
hashes, and do not quote each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import mapped, saved, spread_join

_MARKS = re.compile(r"[ \t]*((?:[>|＞][ \t]?)+)")
_WROTE = re.compile(r"(?:\b(?:wrote|writes|said)|\bschrieb\b.*|\ba écrit|\bescribió)\s*:\s*$", re.I)
_BLANK = re.compile(r"\s+")
_TRIM = "*_`\"'“”„«»"


def normalised(text: str) -> str:
    return _BLANK.sub(" ", text).strip().strip(_TRIM).strip().casefold()


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(text: str) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The text without quotes and attributions, and the passages: (order, level, lines)."""
    own: list[str] = []
    passages: list[tuple[int, int, list[str]]] = []
    level = 0
    for line in text.split("\n"):
        m = _MARKS.match(line)
        depth = sum(c in ">|＞" for c in m[1]) if m and (">" in m[1] or "＞" in m[1]) else 0
        body = line[m.end() :] if depth else line
        if depth > level:  # an attribution stands before the deeper quote
            before = passages[-1][2] if level and passages else own
            while before and not before[-1].strip():
                before.pop()
            if before and _WROTE.search(before[-1]):
                before.pop()
        if not depth:
            own.append(line)
        elif depth != level or not body.strip():
            passages.append((len(passages), depth, [body] if body.strip() else []))
        else:
            passages[-1][2].append(body)
        level = depth
    left = "\n".join(own).strip("\n").rstrip()
    return left, [(i, d, lines) for i, d, lines in passages if lines]


def parsed(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, turn, m (hash of the text), body (without quotes), written (hashes of own passages), quoted (passages with hashes)."""
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("m"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, written, quoted = [], [], []
            for t in b.column(3).to_pylist():
                body, passages = parse(t)
                own = {normalised(body), *map(normalised, re.split(r"\n\s*\n", body)), *map(normalised, body.split("\n"))} - {""}
                bodies.append(body)
                written.append(sorted(map(_hash, own)))
                quoted.append([{"n": i, "level": d, "lines": len(ls), "hash": _hash(normalised("\n".join(ls))), "each": [_hash(normalised(x)) for x in ls]} for i, d, ls in passages])
            kind = pa.list_(pa.struct([("n", pa.int32()), ("level", pa.int32()), ("lines", pa.int32()), ("hash", pa.int64()), ("each", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bodies, pa.string()), pa.array(written, pa.list_(pa.int64())), pa.array(quoted, kind)], names=["conv", "turn", "m", "body", "written", "quoted"])

    return mapped(rows, run, "conv long, turn long, m long, body string, written array<long>, quoted array<struct<n int, level int, lines int, hash long, each array<long>>>")


MESSAGE = ["conv", "turn", "m"]


def links(messages: DataFrame) -> DataFrame:
    """conv, turn, m, n (passage), level, lines, source (turn, m): the earliest message of an earlier turn that wrote each quoted passage."""
    sound = messages.where("conv IS NOT NULL AND turn IS NOT NULL")
    q = saved(sound.select(*MESSAGE, F.explode("quoted").alias("q")).select(*MESSAGE, "q.*").distinct(), "quoted")
    passage = [*MESSAGE, "n", "level"]
    tried = q.select(*passage, F.lit(1).alias("whole"), "lines", F.col("hash").alias("h"))
    tried = saved(tried.unionByName(q.select(*passage, F.lit(0).alias("whole"), F.lit(1).alias("lines"), F.explode("each").alias("h"))), "tried")
    wrote = sound.select(*MESSAGE, F.explode("written").alias("h")).groupBy("conv", "h").agg(F.min(F.struct("turn", "m")).alias("source"))
    asked = tried.groupBy("conv", "h").agg(F.count("*").alias("asked"))
    wrote = saved(asked.join(wrote, ["conv", "h"]).select(F.xxhash64("conv", "h").alias("k"), "asked", F.col("conv").alias("_c"), F.col("h").alias("_h"), "source"), "wrote")
    met = spread_join(tried.withColumn("k", F.xxhash64("conv", "h")), wrote, "k", "asked", passage).where("conv = _c AND h = _h AND source.turn < turn")
    per = met.groupBy(*passage, "source", "whole").agg(F.sum("lines").cast("int").alias("lines"))
    best = F.max_by("source", F.struct("whole", "lines", "source")).alias("source")
    return per.groupBy(*passage).agg(best, F.max("lines").alias("lines"))


def reply_order(messages: DataFrame) -> DataFrame:
    """From distinct (conv, turn, m, q: the quoted message's turn and m): parent, branch (its first message) and place (the message that the
    branch answers), each (turn, m)."""
    key = "struct<turn:bigint,m:bigint>"
    rows = messages.select(*MESSAGE, "q.turn", "q.m").toDF(*MESSAGE, "q_turn", "q_m")
    rows = rows.repartitionByRange(*MESSAGE).sortWithinPartitions(*MESSAGE).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, start, first = None, None, None, True
        for b in batches:
            out = []
            for c, turn, m, q_turn, q_m, _ in zip(*[x.to_pylist() for x in b.columns], strict=True):
                own, quoted = (turn, m), None if q_turn is None else (q_turn, q_m)
                before = last if c == conv else None
                if first:
                    start = None  # it may go on from the partition before
                elif before is None or quoted is not None and quoted != before:
                    start = (own, quoted or before or own)
                out.append((first, before, start and start[0], start and start[1]))
                conv, last, first = c, own, False
            named = lambda x: x and {"turn": x[0], "m": x[1]}
            kind = pa.struct([("turn", pa.int64()), ("m", pa.int64())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.bool_()), *[pa.array([named(o[i]) for o in out], kind) for i in (1, 2, 3)]], names=[*b.schema.names, "first", "before", "branch", "place"])

    rows = saved(mapped(rows, run, f"conv long, turn long, m long, q_turn long, q_m long, part int, first boolean, before {key}, branch {key}, place {key}"), "scanned")
    own, quoted = F.struct("turn", "m"), F.when(F.col("q_turn").isNotNull(), F.struct(F.col("q_turn").alias("turn"), F.col("q_m").alias("m")))
    rows = rows.select("conv", "part", "first", own.alias("own"), quoted.alias("quoted"), "before", "branch", "place")
    # a row for each partition: how it begins and ends
    heads = rows.where("first").select("part", F.col("conv").alias("head_conv"), F.col("own").alias("head"), F.col("quoted").alias("head_quoted"))
    tails = rows.groupBy("part").agg(F.max_by(F.struct("conv", "own", F.struct("branch", "place").alias("start")), F.struct("conv", "own")).alias("tail"))
    ends = heads.join(tails, "part").withColumn("prior", F.lag("tail").over(W.orderBy("part")))
    ends = ends.withColumn("before", F.when(F.col("prior.conv") == F.col("head_conv"), F.col("prior.own")))
    begins = F.col("before").isNull() | (F.col("head_quoted").isNotNull() & (F.col("head_quoted") != F.col("before")))
    ends = ends.withColumn("start", F.when(begins, F.struct(F.col("head").alias("branch"), F.coalesce("head_quoted", "before", "head").alias("place"))))
    tail_start = F.when(F.col("tail.start.branch").isNotNull(), F.col("tail.start"))
    events = ends.select("part", F.lit(0).alias("n"), F.col("head_conv").alias("conv"), "start", "before").unionByName(ends.select("part", F.lit(1).alias("n"), F.col("tail.conv").alias("conv"), tail_start.alias("start"), F.lit(None).cast(key).alias("before")))
    so_far = F.last("start", ignorenulls=True).over(W.partitionBy("conv").orderBy("part", "n").rowsBetween(W.unboundedPreceding, 0))
    carried = events.withColumn("carried", so_far).where("n = 0").select(F.col("part").alias("_p"), F.col("before").alias("_before"), "carried")
    rows = rows.join(F.broadcast(carried), F.col("part") == F.col("_p"))
    before = F.when(F.col("first"), F.col("_before")).otherwise(F.col("before"))
    return rows.select(
        "conv", "own.turn", "own.m", F.coalesce("quoted", before).alias("parent"), F.coalesce("branch", "carried.branch").alias("branch"), F.coalesce("place", "carried.place").alias("place"),
    )


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, message (hash of the text), parent_turn, parent, branch, branch_message, place, place_message (turn and
    hash of the message answered, of the branch's first, and of the one that the branch answers), n_quotes, n_linked, max_level, body. Sorted by
    (place, place_message, branch, branch_message, turn, message), a conversation is in reply order."""
    messages = saved(parsed(df, conv, turn, text), "messages")
    found = saved(links(messages), "links")
    outer = F.max_by("source", F.struct(-F.col("level"), "lines", "source")).alias("q")
    per = found.groupBy(*MESSAGE).agg(outer, F.count("*").alias("n_linked"))
    turns = messages.where("conv IS NOT NULL AND turn IS NOT NULL").select(*MESSAGE).distinct().join(per, MESSAGE, "left")
    turns = saved(turns, "linked")
    order = reply_order(turns.select(*MESSAGE, "q")).join(turns.select(*MESSAGE, "n_linked"), MESSAGE)
    level = F.coalesce(F.array_max(F.transform("quoted", lambda q: q["level"])), F.lit(0))
    out = messages.join(order, MESSAGE, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", F.col("m").alias("message"), F.col("parent.turn").alias("parent_turn"), F.col("parent.m").alias("parent"), F.col("branch.turn").alias("branch"), F.col("branch.m").alias("branch_message"),
        F.col("place.turn").alias("place"), F.col("place.m").alias("place_message"), F.size("quoted").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), level.cast("long").alias("max_level"), "body",
    )


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation."""
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

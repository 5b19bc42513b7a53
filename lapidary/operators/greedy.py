"""Greedy choices under budgets over many rows of one book, in rounds.

A budget's sequential rule (take the next row if it still fits) is decided from both sides: what is certainly taken before a row is a lower
bound of the words used, what is not certainly refused an upper bound. A row that does not fit the lower bound is refused, one that fits
the upper bound is taken; both are final and equal to what the rule would do one by one. The first open row of a book has equal bounds, so
each round decides; in practice most rows go in the first rounds. Running sums are two-level scans, so a book is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import running, written

def fill(rows: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """book_id, block_id, pos of the rows that are taken in order of pos. rows: book_id, block_id, pos (an integer), section_no, word_count,
    total_limit and section_limit (null: none) for the words used, used and section_used (words used before any row of this table), and
    enough (null, or once so many words are used no row is taken). against: book_id, pos, other_pos: a row is refused if the earlier row
    other_pos was taken."""
    state = ("book_id", "block_id", "pos", "section_no", "word_count", "total_limit", "section_limit", "used", "section_used", "enough")
    open_ = written(rows.select(*state), "open")
    taken: DataFrame | None = None
    links = written(against.where("other_pos < pos").select("book_id", "pos", "other_pos").distinct(), "against") if against is not None else None
    if links is not None and links.isEmpty():
        links = None
    while not open_.isEmpty():
        w = F.col("word_count")
        both = running(open_, ["book_id"], "pos", {"_total": w})
        both = running(both, ["book_id", "section_no"], "pos", {"_section": w})
        most_total, most_section = F.col("used") + F.col("_total"), F.col("section_used") + F.col("_section")
        low = F.col("used") + w <= F.col("total_limit")
        low = low & (F.col("section_limit").isNull() | (F.col("section_used") + w <= F.col("section_limit"))) & (F.col("enough").isNull() | (F.col("used") < F.col("enough")))
        high = (most_total <= F.col("total_limit")) & (F.col("section_limit").isNull() | (most_section <= F.col("section_limit")))
        high = high & (F.col("enough").isNull() | (most_total - w < F.col("enough")))
        state_of = F.when(~low, "refused").when(high, "taken").otherwise("open")
        decided = both.withColumn("state", state_of)
        if links is not None:
            others = open_.select("book_id", F.col("pos").alias("other_pos"), F.lit(True).alias("_open"))
            gone = taken.select("book_id", F.col("pos").alias("other_pos"), F.lit(True).alias("_taken")) if taken is not None else None
            met = links.join(others, ["book_id", "other_pos"], "left")
            met = met.join(gone, ["book_id", "other_pos"], "left") if gone is not None else met.withColumn("_taken", F.lit(None).cast("boolean"))
            barred = met.groupBy("book_id", "pos").agg(F.max("_open").alias("_waits"), F.max("_taken").alias("_barred"))
            decided = decided.join(barred, ["book_id", "pos"], "left")
            decided = decided.withColumn("state", F.when(F.col("_barred"), "refused").when(F.col("_waits") & (F.col("state") == "taken"), "open").otherwise(F.col("state")))
        decided = written(decided.select(*state, "state"), "decided")
        now = decided.where("state = 'taken'").select("book_id", "block_id", "pos")
        taken = now if taken is None else written(taken.unionByName(now), "taken")
        more = F.when(F.col("state") == "taken", w).otherwise(0)
        after = running(decided.where("state <> 'refused'"), ["book_id"], "pos", {"_more": more})
        after = running(after, ["book_id", "section_no"], "pos", {"_more_here": more}).where("state = 'open'")
        after = after.withColumns({"used": F.col("used") + F.col("_more"), "section_used": F.col("section_used") + F.col("_more_here")})
        open_ = written(after.select(*state), "open")
    return taken if taken is not None else open_.select("book_id", "block_id", "pos")


def first_fits(demands: DataFrame, options: DataFrame, used: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """book_id, ord, block_id, word_count, fresh: what demands (book_id, ord: an integer) get one after another: the first of their options
    (book_id, ord, place, block_id, word_count) that is chosen already or still fits the book's limit. used: book_id, used, total_limit;
    chosen: book_id, block_id (None: none yet). fresh: the demand was the first to take the block."""
    options = written(options.select("book_id", "ord", "place", "block_id", "word_count"), "options")
    open_ = written(demands.select("book_id", "ord"), "demands")
    state = written(used.select("book_id", "used", "total_limit"), "used")
    none = options.select("book_id", "block_id").limit(0)
    known = written(chosen.select("book_id", "block_id").distinct() if chosen is not None else none, "known")
    met: DataFrame | None = None
    while not open_.isEmpty():
        rows = options.join(open_, ["book_id", "ord"], "left_semi").join(known.withColumn("_known", F.lit(True)), ["book_id", "block_id"], "left").join(state, "book_id")
        fits = F.col("_known") | (F.col("used") + F.col("word_count") <= F.col("total_limit"))
        picks = rows.where(fits).groupBy("book_id", "ord", "used", "total_limit").agg(F.min_by(F.struct("block_id", "word_count", F.coalesce("_known", F.lit(False)).alias("known")), "place").alias("p"))
        picks = picks.select("book_id", "ord", "used", "total_limit", "p.*")
        first = picks.where("NOT known").groupBy("book_id", "block_id").agg(F.min("ord").alias("_first"))
        picks = picks.join(first, ["book_id", "block_id"], "left").withColumn("fresh", F.coalesce(F.col("ord") == F.col("_first"), F.lit(False)))
        summed = running(picks, ["book_id"], "ord", {"_sum": F.when(F.col("fresh"), F.col("word_count")).otherwise(0)})
        summed = written(summed.withColumn("_ok", F.col("used") + F.col("_sum") <= F.col("total_limit")).select("book_id", "ord", "block_id", "word_count", "fresh", "_ok"), "picks")
        now = summed.where("_ok").drop("_ok")
        met = now if met is None else written(met.unionByName(now), "met")
        taken = now.where("fresh")
        known = written(known.unionByName(taken.select("book_id", "block_id")), "known")
        words = taken.groupBy("book_id").agg(F.sum("word_count").alias("_new"))
        state = written(state.join(words, "book_id", "left").select("book_id", (F.col("used") + F.coalesce("_new", F.lit(0))).alias("used"), "total_limit"), "used")
        # a demand without a fitting option stays without one: what does not fit now is never chosen later
        open_ = written(summed.where("NOT _ok").select("book_id", "ord"), "demands")
    return met if met is not None else options.select("book_id", "ord", "block_id", "word_count", F.lit(True).alias("fresh")).limit(0)

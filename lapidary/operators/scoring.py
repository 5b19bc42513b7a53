"""Rubric scores, utilities and rankings of candidate passages; all arithmetic in doubles, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Weights of the rubric's parts.
ANALYTIC = {"unity": 4, "term": 3, "proposition": 4, "support": 4, "objection": 3, "conclusion": 3, "dependency": 2}
ARC = {"necessity": 2, "importance": 2, "turning": 1, "density": 1}
PENALTIES = {"redundancy": 2, "detail": 2, "context": 2}
NARRATIVE_FORMS = ("historical_investigative_narrative", "biography_memoir")
PRIORITIES = {"high": 1.18, "medium": 1.0, "low": 0.86}
CONTINUITY = ("setup", "turning_point", "consequence", "interpretation", "conclusion")
NEUTRAL = 10.0


def _weighted(weights: dict[str, int]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * F.lit(float(w))
    return total


def rubric(form: Column) -> Column:
    """Score of a row with the rubric's columns (integers) for a book of the given form."""
    narrative = form.isin(*NARRATIVE_FORMS)
    analytic = _weighted(ANALYTIC) * F.when(narrative, F.lit(0.8)).otherwise(F.lit(1.0))
    arc = _weighted(ARC) * F.when(narrative, F.lit(1.4)).otherwise(F.lit(1.0))
    return analytic + arc + F.col("readability") - _weighted(PENALTIES)


def with_scores(blocks: DataFrame, scores: DataFrame) -> DataFrame:
    """Joins scores (book_id, block_id, seq, score) to blocks: of repeated ones the last counts, missing ones are neutral."""
    last = scores.groupBy("book_id", "block_id").agg(F.max_by("score", "seq").alias("score"))
    return blocks.join(last, ["book_id", "block_id"], "left").withColumn("score", F.coalesce("score", F.lit(NEUTRAL)))


def with_priority(rows: DataFrame, priorities: DataFrame) -> DataFrame:
    """Joins (book_id, section_no, seq, priority), the last of repeated ones, lower-cased; missing: medium."""
    last = priorities.groupBy("book_id", "section_no").agg(F.lower(F.max_by("priority", "seq")).alias("priority"))
    return rows.join(last, ["book_id", "section_no"], "left").withColumn("priority", F.coalesce("priority", F.lit("medium")))


def utility(score: Column, words: Column, priority: Column, function: Column, covers: Column, terms: Column, supports: Column) -> Column:
    """Value per root of a word, raised by priority, continuity and the number of distinct requirements."""
    factor = F.lit(1.0)
    for name, f in PRIORITIES.items():
        factor = F.when(priority == name, F.lit(f)).otherwise(factor)
    bonus = F.when(function.isin(*CONTINUITY), F.lit(1.07)).otherwise(F.lit(1.0))
    tags = F.size(F.array_union(F.array_union(covers, terms), supports))
    return factor * bonus * (F.lit(1.0) + F.lit(0.04) * tags) * score / F.sqrt(F.greatest(words, F.lit(1)).cast("double"))


def ranked(rows: DataFrame, by: str = "utility") -> DataFrame:
    """Adds rank (from 1) per book: utility descending, then candidate position."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("book_id").orderBy(F.desc(by), "cand_pos")).cast("long"))


def residual_rank(rows: DataFrame, used: str, target: str) -> DataFrame:
    """Adds rank: distance of used + words from the target, then utility descending, then candidate position."""
    gap = F.abs(F.col(used) + F.col("word_count") - F.col(target))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("book_id").orderBy(gap, F.desc("utility"), "cand_pos")).cast("long"))


def top_alternatives(candidates: DataFrame, chosen: DataFrame, k: int = 30) -> DataFrame:
    """The k best unselected candidates of each book by score, then candidate position."""
    left = candidates.join(chosen.select("book_id", "block_id"), ["book_id", "block_id"], "left_anti")
    place = F.row_number().over(W.partitionBy("book_id").orderBy(F.desc("score"), "cand_pos"))
    return left.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)

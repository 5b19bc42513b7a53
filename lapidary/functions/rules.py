"""Predicates and classifications of sections, and checks that report violations instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import W, canonical_title

#: Canonical titles begin with one of these.
EXCLUDED = (
    "copyright|contents|table of contents|bibliography|references|works cited|index|notes|endnotes|acknowledg(?:e)?ments?|list of interviews|written correspondence|"
    r"interviews and written|photo[\s-]?insert|illustrations|plates|image credits|about the author|unmapped front matter"
)
FRONT = "introduction|prologue|preface|foreword"
ENDING = "epilogue|conclusion|afterword"
#: Document roles and the section they name, in order of priority.
SEMANTIC = {
    "backmatter": "Notes", "endnotes": "Notes", "rearnotes": "Notes", "footnotes": "Notes", "bibliography": "Bibliography",
    "index": "Index", "acknowledgments": "Acknowledgments", "copyright-page": "Copyright", "colophon": "Copyright",
}
SHORT_PART, IMPLAUSIBLE_WORDS, FEWEST_SECTIONS, MOST_EXCLUDED = 50, 30_000, 3, 0.50


def section_kind(title: Column | str) -> Column:
    """exclude, front, ending or body, by the reader-visible title; the first that fits."""
    t = canonical_title(title)
    opens = lambda words: t.rlike(rf"\A(?:{words})(?!{W})")
    return F.when(opens(EXCLUDED), "exclude").when(opens(FRONT), "front").when(opens(ENDING), "ending").otherwise("body")


def section_kind_by_words(title: Column | str, words: Column) -> Column:
    """As section_kind(), but a part's title page (under 50 words) is left out."""
    part = canonical_title(title).rlike(rf"\Apart(?!{W})") & (words < SHORT_PART)
    return F.when(part, "exclude").otherwise(section_kind(title))


def coverage_required(mode: str, kind: Column, priority: Column) -> Column:
    """Whether a section must be covered: all, or (major) front and ending matter and sections of high or medium priority."""
    if mode == "all":
        return F.lit(True)
    if mode == "major":
        return kind.isin("front", "ending") | F.coalesce(priority, F.lit("medium")).isin("high", "medium")
    return F.lit(False)


def structure_violations(sections: DataFrame, proceed: DataFrame | None = None) -> DataFrame:
    """book_id, included, total_words, excluded_words, violations: why a book's structure is not to be trusted (empty: it is).
    sections: book_id, kind, word_count; proceed: book_id, proceed (null: not reported)."""
    body = F.col("kind") != "exclude"
    per = sections.groupBy("book_id").agg(
        F.count_if(body & (F.col("word_count") > 0)).cast("long").alias("included"),
        F.coalesce(F.sum(F.when(body, F.col("word_count"))), F.lit(0)).cast("long").alias("total_words"),
        F.coalesce(F.sum(F.when(~body, F.col("word_count"))), F.lit(0)).cast("long").alias("excluded_words"),
    )
    per = per.join(proceed, "book_id", "left") if proceed is not None else per.withColumn("proceed", F.lit(None).cast("boolean"))
    everything = F.col("total_words") + F.col("excluded_words")
    checks = {
        "low confidence": F.coalesce(~F.col("proceed"), F.lit(False)),
        "no included words": F.col("total_words") <= 0,
        "too few sections": (F.col("total_words") > IMPLAUSIBLE_WORDS) & (F.col("included") < FEWEST_SECTIONS),
        "mostly excluded": (everything > 0) & (F.col("excluded_words") / F.greatest(everything, F.lit(1)) > MOST_EXCLUDED),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return per.select("book_id", "included", "total_words", "excluded_words", found.alias("violations"))

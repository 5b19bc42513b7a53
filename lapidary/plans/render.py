"""Documents as tables of lines (book_id, place: array of numbers, line), joined into one text per book at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import escape_cell, kind_title, strip

NOTE = "*All passages below are the author's own words, unchanged. A row of stars stands where something was left out. A line in italics after one leads over to the next passage and was written for this edition.*"


def _lines(df: DataFrame, place: list, lines: list) -> DataFrame:
    """For every row its lines at place (numbers or columns), in order."""
    at = F.array(*[F.lit(p).cast("long") if not isinstance(p, Column) else F.coalesce(p.cast("long"), F.lit(10**6).cast("long")) for p in place])
    texts = F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])
    out = df.select("book_id", at.alias("at"), F.posexplode(texts).alias("n", "line")).where("line IS NOT NULL")
    return out.select("book_id", F.concat("at", F.array(F.col("n").cast("long"))).alias("place"), "line")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_text(lines: DataFrame) -> DataFrame:
    """book_id, text: each book's lines in order, without blank lines at the end."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return lines.groupBy("book_id").agg(F.concat(F.regexp_replace(F.array_join(listed, "\n"), r"\s+\z", ""), F.lit("\n")).alias("text"))


def write_parts(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes each book's lines in order as text under path/book_id=...: its part files, by name, one after another are as_text(). Lines are
    range-partitioned by book and place, so a long book fills many parts, and no book has to fit a row or a task."""
    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = lines.where(strip("line") != "").groupBy("book_id").agg(F.max("place").alias("_last"))
    rows = lines.join(last, "book_id").where(F.col("place") <= F.col("_last"))
    # a book's last line loses white space at its end, as the text does
    rows = rows.withColumn("line", F.when(F.col("place") == F.col("_last"), F.regexp_replace("line", r"\s+\z", "")).otherwise(F.col("line")))
    rows = rows.repartitionByRange(n, "book_id", "place").sortWithinPartitions("book_id", "place")
    rows.select("book_id", F.col("line").alias("value")).write.partitionBy("book_id").mode("overwrite").text(path)


def edition(chosen: DataFrame, sections: DataFrame, bridges: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """The reading edition. chosen: book_id, block_id, section_no, reading_pos, text; sections: book_id, section_no, section_pos, title;
    bridges: book_id, after_id, pos, text, necessary (the last for a block counts); books: book_id, title."""
    titles = books if books is not None else chosen.select("book_id").distinct().withColumn("title", F.col("book_id"))
    spoken = bridges.where(F.col("necessary") & (strip("text") != "")).groupBy("book_id", F.col("after_id").alias("block_id")).agg(F.max_by(strip("text"), "pos").alias("bridge"))
    rows = chosen.join(sections.select("book_id", "section_no", "section_pos"), ["book_id", "section_no"], "left").join(spoken, ["book_id", "block_id"], "left")
    first = F.col("reading_pos") == F.min("reading_pos").over(W.partitionBy("book_id"))
    rows = rows.withColumn("first", first)
    rule, blank = F.when(~F.col("first"), "* * *"), F.when(~F.col("first"), "")
    bridge = F.when(~F.col("first") & F.col("bridge").isNotNull(), F.concat(F.lit("*[Leading on] "), "bridge", F.lit("*")))
    shown = sections.join(chosen.select("book_id", "section_no").distinct(), ["book_id", "section_no"], "left_semi")
    return _union([
        _lines(titles, [0, 0, 0], [F.concat(F.lit("# "), "title"), "", NOTE, ""]),
        _lines(shown, [1, F.col("section_pos"), 0], [F.concat(F.lit("## "), "title"), ""]),
        _lines(rows, [1, F.col("section_pos"), F.col("reading_pos")], [blank, rule, blank, bridge, F.when(bridge.isNotNull(), ""), strip("text"), ""]),
    ])


def structure_report(sections: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """What was read: word totals, a table of sections (book_id, section_no, section_id, title, kind, paragraphs, word_count) and, from about
    (book_id, diagnostics as JSON, error), how sure the reading is and what to look at."""
    kept = F.col("kind") != "exclude"
    sum_of = lambda which: F.coalesce(F.sum(F.when(which, F.col("word_count"))), F.lit(0))
    totals = sections.groupBy("book_id").agg(F.count("*").alias("n"), sum_of(kept).alias("read"), sum_of(~kept).alias("left"))
    row = F.concat(F.lit("| "), "section_id", F.lit(" | "), escape_cell("title"), F.lit(" | "), "kind", F.lit(" | "), "paragraphs", F.lit(" | "), "word_count", F.lit(" |"))
    head = [
        F.concat(F.lit("# What was read: "), "book_id"), "", F.concat("n", F.lit(" sections; "), "read", F.lit(" words to choose from, "), "left", F.lit(" words set aside.")), "",
        "| Section | Heading | Use | Paragraphs | Words |", "|---|---|---|---:|---:|",
    ]
    parts = [_lines(totals, [0, 0], head), _lines(sections, [1, F.col("section_no")], [row])]
    if about is not None:
        said = about.select("book_id", "error", F.from_json("diagnostics", "contents_from string, confidence string, proceed boolean, image_risk string, images_shown long, front_words long, fixed_layout array<string>, notes array<string>").alias("d"))
        line = lambda label, c: F.concat(F.lit(f"- {label}: "), c)
        how = [
            "", "## How sure the reading is", "", line("Sections come from", F.col("d.contents_from")), line("Confidence", F.col("d.confidence")), line("Fit to go on", F.when(F.col("d.proceed"), "yes").when(~F.col("d.proceed"), "no")),
            line("Risk that pages are pictures", F.col("d.image_risk")), line("Pictures shown", F.col("d.images_shown")), line("Words before any section", F.col("d.front_words")), line("Drawn pages, by", F.when(F.size("d.fixed_layout") > 0, F.array_join("d.fixed_layout", ", "))),
        ]
        parts.append(_lines(said.where("d.confidence IS NOT NULL OR d.image_risk IS NOT NULL"), [2, 0], how))
        warned = said.select("book_id", F.concat(F.coalesce("d.notes", F.array().cast("array<string>")), F.array_compact(F.array("error"))).alias("all")).where(F.size("all") > 0)
        parts.append(_lines(warned, [3, 0], ["", "## To look at", ""]))
        parts.append(_lines(warned.select("book_id", F.posexplode("all").alias("k", "note")), [4, F.col("k")], [F.concat(F.lit("- "), "note")]))
    return _union(parts)


def _listed(c: Column | str, none: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)


def percent(part: Column, whole: Column) -> Column:
    """One decimal, half to even on the decimal value."""
    return F.concat(F.bround(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), 1).cast("string"), F.lit("%"))


def audit(books: DataFrame, sections: DataFrame, chosen: DataFrame, coverage: DataFrame, bridges: DataFrame, review: DataFrame) -> DataFrame:
    """Why the edition is as it is: first the review, then what each section gave, the passages, the requirements, the bridges. books: book_id, title,
    total_words, target, selected, bridge_words, overlap_words, overview, form, question, thesis; sections: book_id, section_pos, title, word_count, retained (included
    ones); chosen: passages in listing order with pos, range, reason; coverage: book_id, pos, requirement_id, description, kind, importance, must, block_ids; bridges:
    book_id, pos, before_id, after_id, kind, text, grounding_blocks, grounding_requirements; review: book_id, assessment, missing, unsupported, undefined, notes."""
    number = lambda c: F.format_number(c, 0)
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), c)
    cell = lambda *xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    head = [
        F.concat(F.lit("# How this edition was chosen: "), "title"), "",
        F.concat(number("selected"), F.lit(" of "), number("total_words"), F.lit(" words kept ("), percent(F.col("selected"), F.col("total_words")), F.lit("), with a budget of "), number("target"), F.lit("; "), number("bridge_words"), F.lit(" words of bridges added.")), "",
        F.when(F.col("overlap_words") > 0, F.concat(number("overlap_words"), F.lit(" of these words stand in more than one passage and are counted each time."))), F.when(F.col("overlap_words") > 0, ""),
        line("Kind of book", F.col("form")), line("It asks", F.col("question")), line("It holds", F.col("thesis")), line("In short", F.col("overview")), "",
    ]
    known = lambda c: F.array_compact(F.coalesce(c, F.array().cast("array<string>")))
    reviewed = [
        "## Review", "", F.coalesce("assessment", F.lit("")), "", line("Left out though needed", _listed(known("missing"), "nothing")), line("Without support", _listed(known("unsupported"), "nothing")), line("Terms not defined", _listed(known("undefined"), "none")), "",
    ]
    notes = review.select("book_id", F.posexplode("notes").alias("k", "n")).select("book_id", "k", "n.*")
    all_kept = F.sum("retained").over(W.partitionBy("book_id"))
    block = [
        F.concat(F.lit("**"), "block_id", F.lit("** ("), "range", F.lit("), "), "word_count", F.lit(" words, score "), F.bround("score", 1), F.lit(", "), "block_function"), line("Chosen for", F.col("reason")),
        line("Meets", _listed("covers", "no requirement")), line("Defines", _listed("terms", "no term")), line("Supports", _listed("supports", "no proposition")), line("Kept safe for", _listed("protected_for", "no requirement")), line("The section's anchor", F.when(F.col("protected"), "yes").otherwise("no")), "",
    ]
    state = F.when(F.size("block_ids") > 0, "met").when(F.col("must"), "MISSING").otherwise("dropped")
    return _union([
        _lines(books, [0, 0], head),
        _lines(review, [1, 0], reviewed), _lines(notes, [2, F.col("k")], [F.concat(F.lit("- Before "), "before_id", F.lit(": "), "note")]),
        _lines(books, [3, 0], ["", "## What each section gave", "", "| Section | Words | Kept | Of the section | Of the edition |", "|---|---:|---:|---:|---:|"]),
        _lines(sections.withColumn("_all", all_kept), [4, F.col("section_pos")], [cell(escape_cell("title"), number("word_count"), F.when(F.col("retained") > 0, number("retained")).otherwise("nothing"), percent(F.col("retained"), F.col("word_count")), percent(F.col("retained"), F.col("_all")))]),
        _lines(books, [5, 0], ["", "## Passages", ""]), _lines(chosen, [6, F.col("pos")], block),
        _lines(books, [7, 0], ["## Requirements", "", "| Id | What | Kind | Weight | Needed | Met by | State |", "|---|---|---|---|---|---|---|"]),
        _lines(coverage, [8, F.col("pos")], [cell("requirement_id", escape_cell("description"), "kind", "importance", F.when(F.col("must"), "yes").otherwise("no"), _listed("block_ids", "none"), state)]),
        _lines(bridges.select("book_id").distinct(), [9, 0], ["", "## Bridges", ""]),
        _lines(bridges, [10, F.col("pos")], [F.concat("before_id", F.lit(" to "), "after_id", F.lit(" ("), F.coalesce("kind", F.lit("no kind")), F.lit("): "), "text"), line("Rests on", _listed(F.concat("grounding_blocks", F.coalesce("grounding_requirements", F.array().cast("array<string>"))), "nothing named")), ""]),
    ])


def guide(books: DataFrame, path: DataFrame, requirements: DataFrame, supports: DataFrame) -> DataFrame:
    """How to read the edition: the shortest way through it, the claims with what bears them, the terms. books: book_id, title, problem, unity; path: book_id, pos,
    requirement_id, kind, description, places (array); requirements: with block_ids; supports: book_id, pos (of the proposition), n, source, description, block_ids."""
    kept = lambda c: _listed(c, "left out")
    step = F.row_number().over(W.partitionBy("book_id").orderBy("pos"))
    claims, terms = (requirements.where(F.col("kind") == k) for k in ("major_proposition", "essential_term"))
    return _union([
        _lines(books, [0, 0, 0], [F.concat(F.lit("# Reading "), "title"), "", F.concat(F.lit("The question: "), F.coalesce("problem", F.lit("not stated"))), "", F.concat(F.lit("What holds it together: "), F.coalesce("unity", F.lit("not stated"))), "", "## The shortest way through", ""]),
        _lines(path.withColumn("step", step), [1, F.col("pos"), 0], [F.concat("step", F.lit(". "), "description", F.lit(" ["), kind_title("kind"), F.lit(" "), "requirement_id", F.lit("] "), F.when(F.size("places") > 0, F.concat(F.lit("at "), F.array_join("places", "; "))).otherwise("was left out"))]),
        _lines(books, [2, 0, 0], ["", "## Claims and what bears them", ""]),
        _lines(claims, [3, F.col("pos"), 0], [F.concat(F.lit("**"), "requirement_id", F.lit("** "), "description", F.lit(" — in "), kept("block_ids"))]),
        _lines(supports, [3, F.col("pos"), F.col("n") + 1], [F.concat(F.lit("- borne by "), "source", F.lit(" ("), "description", F.lit("), in "), kept("block_ids"))]),
        _lines(books, [4, 0, 0], ["", "## Terms", ""]),
        _lines(terms, [5, F.col("pos"), 0], [F.concat(F.lit("- "), "description", F.lit(" ("), "requirement_id", F.lit("), in "), kept("block_ids"))]),
    ])

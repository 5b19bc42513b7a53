"""Books, sections and paragraphs: identifiers, segmentation, chunks, runs, excerpts and word totals.

Tables are keyed by book_id; order is always by numeric ordinals, never by padded identifiers. What runs through a book in order (headings
carried on, numbers, words so far, chunks) is scanned in two levels, so a book of any size spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules, text
from . import scans
from .scans import running


def segment_lines(lines: DataFrame, is_heading: Callable[[Column], Column] = text.is_heading) -> DataFrame:
    """Text lines (book_id, line_no, line) to sections (book_id, section_pos, title, text). A heading line (in Markdown, or by is_heading) starts a section, of
    stacked headings the last names it; lines before any heading are "Opening"; a book without text lines under headings is one
    section "Book text" of all its lines."""
    title = text.heading_title("line")
    heading = text.is_markdown_heading("line") | ((F.char_length(title) < 120) & is_heading(title))
    marked = running(lines.withColumn("heading", heading), ["book_id"], "line_no", {"segment": F.col("heading").cast("int")})
    marked = marked.withColumn("title", F.when(F.col("heading"), title))
    line = lambda rows: F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    parts = marked.groupBy("book_id", "segment").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("line_no", "heading", "line"))).alias("all"))
    parts = parts.select("book_id", "segment", "title", text.strip(line(F.filter("all", lambda x: ~x["heading"]))).alias("text"), line(F.col("all")).alias("whole"))
    # texts are put together once, and stay out of what follows
    parts = scans.written(parts.withColumn("whole", F.when(F.col("text") == "", F.col("whole"))), "segments")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "whole"))), lambda x: x["whole"]), "\n")
    bare = parts.where("text = ''").join(parts.where("text <> ''").select("book_id").distinct(), "book_id", "left_anti").groupBy("book_id").agg(whole.alias("text"))
    parts = parts.where("text <> ''").select("book_id", "segment", F.coalesce("title", F.lit("Opening")).alias("title"), "text")
    parts = parts.unionByName(bare.select("book_id", F.lit(0).cast("long").alias("segment"), F.lit("Book text").alias("title"), "text"))
    places = running(parts.select("book_id", "segment"), ["book_id"], "segment", {"section_pos": F.lit(1).cast("long")})
    return parts.join(places, ["book_id", "segment"]).select("book_id", "section_pos", "title", "text")


def section_blocks(sections: DataFrame) -> DataFrame:
    """Sections (book_id, section_pos, title, text) to raw blocks (book_id, section_pos, title, block_pos, text, page)."""
    blocks = sections.select("book_id", "section_pos", "title", F.posexplode_outer(text.split_paragraphs("text")).alias("block_pos", "block"))
    return blocks.where("block IS NOT NULL").select("book_id", "section_pos", "title", (F.col("block_pos") + 1).cast("long").alias("block_pos"), F.col("block").alias("text"), F.lit(None).cast("int").alias("page"))


def _section_title() -> Column:
    title = text.strip("title")
    return F.when(title == "", F.concat(F.lit("Section "), F.col("section_pos"))).otherwise(title)


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Raw blocks to paragraphs with identifiers: sections with a raw block are numbered from 1, paragraphs by their place among the
    section's raw blocks, so that dropped blocks leave gaps. Titles that are blank become "Section n" by section_pos."""
    title = _section_title()
    one = F.lit(1).cast("long")
    numbers = running(blocks.select("book_id", "section_pos").distinct(), ["book_id"], "section_pos", {"section_no": one})
    placed = running(blocks, ["book_id", "section_pos"], "block_pos", {"idx": one}).join(numbers, ["book_id", "section_pos"])
    # made once: what an explode has made is filtered after it
    made = F.explode(F.array(text.normalize("text")))
    raw = placed.withColumns({"title": title, "text": made}).withColumn("word_count", F.explode(F.array(text.word_count("text"))))
    section = text.numbered("CH", "section_no")
    return raw.where((F.col("text") != "") & (F.col("word_count") >= 2)).select(
        "book_id", "section_no", section.alias("section_id"), "title", "idx", F.concat(section, F.format_string("-P%04d", "idx")).alias("paragraph_id"), "text", "word_count", "page",
    )


def sections(paras: DataFrame) -> DataFrame:
    """book_id, section_no, section_id, title, kind, paragraphs, word_count."""
    per = paras.groupBy("book_id", "section_no", "section_id", "title").agg(F.count("*").alias("paragraphs"), F.sum("word_count").alias("word_count"))
    return per.withColumn("kind", rules.section_kind_by_words("title", F.col("word_count")))


def sections_of_blocks(blocks: DataFrame) -> DataFrame:
    """sections(paragraphs(blocks)) by one reading of the blocks: what they hold is counted before sections are numbered, so no text moves."""
    made = blocks.select("book_id", "section_pos", _section_title().alias("title"), F.explode(F.array(text.normalize("text"))).alias("text"))
    words = made.select("book_id", "section_pos", "title", F.explode(F.array(text.word_count("text"))).alias("words"))
    kept = F.col("words") >= 2
    per = words.groupBy("book_id", "section_pos", "title").agg(F.count_if(kept).cast("long").alias("paragraphs"), F.sum(F.when(kept, F.col("words"))).alias("word_count"))
    per = scans.written(per, "sections")
    numbers = running(per.select("book_id", "section_pos").distinct(), ["book_id"], "section_pos", {"section_no": F.lit(1).cast("long")})
    rows = per.where("paragraphs > 0").join(numbers.hint("merge"), ["book_id", "section_pos"])
    rows = rows.select("book_id", "section_no", text.numbered("CH", "section_no").alias("section_id"), "title", "paragraphs", "word_count")
    return rows.withColumn("kind", rules.section_kind_by_words("title", F.col("word_count")))


def books(secs: DataFrame) -> DataFrame:
    """book_id and total_words, over sections that are not excluded."""
    return secs.groupBy("book_id").agg(F.coalesce(F.sum(F.when(F.col("kind") != "exclude", F.col("word_count"))), F.lit(0)).alias("total_words"))


class Fold:
    """What a stretch of rows does to a bin that is open before it, for every count of words the bin may hold: the first row that opens a new
    bin is found in the stretch's running words; from each row on, the bins that follow and the words of the last are known."""

    def __init__(self, heads: np.ndarray, left: np.ndarray, made: np.ndarray, total: int) -> None:
        #: running words up to the first row above `most`; for a new bin opened at each of these rows, words of the last bin and bins made
        self.heads, self.left, self.made, self.total = heads, left, made, total

    def after(self, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of the open bin after the stretch, and bins made in it; words before it: NEW if none is open."""
        first = np.searchsorted(self.heads, most - words, "right")
        goes_on = first == len(self.heads)  # only if no row of the stretch passes `most`
        at = np.minimum(first, len(self.heads) - 1)
        return np.where(goes_on, words + self.total, self.left[at]), np.where(goes_on, 0, self.made[at])


#: The most rows of a key that are folded in one array, and blocks whose folds are joined to one.
SHORT, GROUP = 2_048, 128
#: Words of a bin that takes no row: what stands before a key's first.
NEW = 1 << 60


def starts_after(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Running words, and for each row the row at which the next bin would open if it opened one."""
    total = np.cumsum(words)
    following = np.searchsorted(total, total - words + most, "right")
    return total, np.maximum(following, np.arange(len(words)) + 1)


def fold_of(words: np.ndarray, most: int) -> Fold:
    total, following = starts_after(words, most)
    n = len(words)
    left, made = np.zeros(n, np.int64), np.ones(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = following[i]
        if j >= n:
            left[i] = total[-1] - total[i] + words[i]
        else:
            left[i], made[i] = left[j], made[j] + 1
    heads = int(np.searchsorted(total, most, "right")) + 1
    return Fold(total[:heads], left[:heads], made[:heads], int(total[-1]))


def joined_folds(folds: list[Fold], most: int) -> Fold:
    """One stretch out of several in a row."""
    heads, left, made, before = [], [], [], 0
    for i, f in enumerate(folds):
        words, bins_made = f.left, f.made
        for g in folds[i + 1 :]:
            words, more = g.after(words, most)
            bins_made = bins_made + more
        heads.append(f.heads + before)
        left.append(words)
        made.append(bins_made)
        before += f.total
        if before > most:  # rows further on open no first bin
            break
    return Fold(np.concatenate(heads), np.concatenate(left), np.concatenate(made), sum(f.total for f in folds))


def bins(rows: DataFrame, keys: list[str], order: str, words: str, most: int, into: str = "chunk", short: int | None = None) -> DataFrame:
    """Adds the number (from 1) of the consecutive bin of at most `most` words; a longer row stands alone. A bin's end depends on all
    before it. Keys of up to SHORT rows are folded in one array; of larger ones, blocks of rows are folded for every state they may be
    entered in (Fold), groups of blocks are joined to one fold, each key's groups are walked in order, then the blocks of each group,
    and last the rows of each block: a task holds a block's numbers or a group's folds, whatever the size of the key. order: an integer
    position, distinct within a key."""
    return scans.apart(rows, keys, SHORT if short is None else short, lambda x: _short_bins(x, keys, order, words, most, into), lambda x: _long_bins(x, keys, order, words, most, into))


def _short_bins(rows: DataFrame, keys: list[str], order: str, words: str, most: int, into: str) -> DataFrame:
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(words).cast("long").alias("w")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["bin"] == 0) | (a["used"] + x["w"] > most)
        b = F.when(new, a["bin"] + 1).otherwise(a["bin"])
        return F.struct(b.alias("bin"), F.when(new, x["w"]).otherwise(a["used"] + x["w"]).alias("used"), F.concat(a["out"], F.array(b)).alias("out"))

    folded = per.select(*keys, F.explode(F.arrays_zip(F.col("all.o").alias("o"), F.aggregate("all", start, step)["out"].alias("b"))).alias("z"))
    folded = folded.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("z.o").alias("_o"), F.col("z.b").alias(into))
    on = rows[order] == folded["_o"]
    for k in keys:
        on = on & rows[k].eqNullSafe(folded[f"_{k}"])
    return rows.join(folded, on).drop("_o", *[f"_{k}" for k in keys])


def _long_bins(rows: DataFrame, keys: list[str], order: str, words: str, most: int, into: str) -> DataFrame:
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys)
    block = F.floor(F.col(order) / scans.BLOCK).alias("_block")
    narrow = rows.select(*keys, F.col(order).cast("long").alias("_o"), F.coalesce(F.col(words).cast("long"), F.lit(0).cast("long")).alias("_w"), block)
    schema = f"{kinds}, _block long, heads array<long>, left array<long>, made array<long>, total long"

    def folded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = fold_of(pdf.sort_values("_o")["_w"].to_numpy(), most)
        return pd.DataFrame([(*key, f.heads, f.left, f.made, f.total)], columns=[*keys, "_block", "heads", "left", "made", "total"])

    def of(pdf: pd.DataFrame) -> list[Fold]:
        return [Fold(np.asarray(r.heads), np.asarray(r.left), np.asarray(r.made), r.total) for r in pdf.sort_values("_block").itertuples()]

    def grouped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = joined_folds(of(pdf), most)
        return pd.DataFrame([(*key, f.heads, f.left, f.made, f.total)], columns=[*keys, "_block", "heads", "left", "made", "total"])

    def walked(pdf: pd.DataFrame, state: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
        """Each stretch with the words of the bin open before it and the bins before it."""
        words_open, done = state
        for at, f in zip(sorted(pdf["_block"]), of(pdf), strict=True):
            yield at, words_open, done
            after, more = f.after(np.array([words_open]), most)
            words_open, done = int(after[0]), done + int(more[0])

    entered = f"{kinds}, _block long, _open long, _done long"

    def walk_key(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x) for x in walked(pdf, (NEW, 0))], columns=[*keys, "_block", "_open", "_done"])

    def walk_group(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        first = (int(state["_open"].iloc[0]), int(state["_done"].iloc[0]))
        return pd.DataFrame([(*key[:-1], *x) for x in walked(pdf, first)], columns=[*keys, "_block", "_open", "_done"])

    def numbered_rows(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        w = pdf["_w"].to_numpy()
        total, following = starts_after(w, most)
        at = int(np.searchsorted(total, most - int(state["_open"].iloc[0]), "right"))
        opens = np.zeros(len(w), np.int64)
        while at < len(w):
            opens[at] = 1
            at = following[at]
        return pdf[[*keys, "_o"]].assign(_bin=np.cumsum(opens) + int(state["_done"].iloc[0]))

    blocks = narrow.groupBy(*keys, "_block").applyInPandas(folded, schema)
    blocks = scans.written(blocks, "folds")
    group = F.floor(F.col("_block") / GROUP)
    groups = blocks.groupBy(*keys, group.alias("_group")).applyInPandas(grouped, schema)
    of_groups = groups.groupBy(*keys).applyInPandas(walk_key, entered).withColumnRenamed("_block", "_group")
    of_blocks = blocks.groupBy(*keys, group.alias("_group")).cogroup(of_groups.groupBy(*keys, "_group")).applyInPandas(walk_group, entered)
    found = narrow.groupBy(*keys, "_block").cogroup(of_blocks.groupBy(*keys, "_block")).applyInPandas(numbered_rows, f"{kinds}, _o long, _bin long")
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "_o", F.col("_bin").alias(into))
    on = rows[order] == found["_o"]
    for k in keys:
        on = on & rows[k].eqNullSafe(found[f"_{k}"])
    return rows.join(found, on).drop("_o", *[f"_{k}" for k in keys])


def runs(rows: DataFrame, keys: list[str], position: str, into: str = "run") -> DataFrame:
    """Adds the number (from 1) of the run of consecutive positions; repeated positions of a key count once."""
    w = W.partitionBy(*keys).orderBy(position)
    rows = rows.dropDuplicates([*keys, position]).withColumn("_island", F.col(position) - F.row_number().over(w))
    return rows.withColumn(into, F.dense_rank().over(W.partitionBy(*keys).orderBy("_island")).cast("long")).drop("_island")


def run_blocks(rows: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Runs of nominated paragraphs (keys, position, paragraph_id, text, word_count, reason) to passages; a nomination that falls into
    several runs says so in its reason."""
    marked = runs(rows, keys, position)
    listed = F.array_sort(F.collect_list(F.struct(position, "paragraph_id", "text")))
    per = marked.groupBy(*keys, "run").agg(listed.alias("all"), F.sum("word_count").alias("word_count"), F.first("reason").alias("reason"))
    n = F.count("*").over(W.partitionBy(*keys))
    note = F.when(n > 1, F.format_string(" (run %d of %d of a passage with gaps)", "run", n)).otherwise("")
    return per.select(*keys, "run", F.col("all.paragraph_id").alias("paragraph_ids"), F.array_join(F.col("all.text"), "\n\n").alias("text"), "word_count", F.concat("reason", note).alias("reason"))


def excerpt(rows: DataFrame, keys: list[str], order: str, words: str, most: Column | int) -> DataFrame:
    """The rows before the first that would pass `most` words."""
    return running(rows, keys, order, {"_so_far": F.col(words)}).where(F.col("_so_far") <= most).drop("_so_far")


def overview_excerpt(paras: DataFrame, secs: DataFrame, most: int) -> DataFrame:
    """Paragraphs of the opening sections (else the first of the body) and the ending ones (else the last of the body), each section up to
    max(1000, most / number of those sections) words: book_id, part (front, ending), section_no, idx, paragraph_id, word_count."""
    body = secs.where("kind = 'body'")
    first = body.groupBy("book_id").agg(F.min("section_no").alias("first"), F.max("section_no").alias("last"))
    has = secs.groupBy("book_id").agg(F.count_if(F.col("kind") == "front").alias("fronts"), F.count_if(F.col("kind") == "ending").alias("ends")).join(first, "book_id", "left")
    s = secs.join(has, "book_id")
    front = (F.col("kind") == "front") | ((F.col("fronts") == 0) & (F.col("section_no") == F.col("first")))
    ending = (F.col("kind") == "ending") | ((F.col("ends") == 0) & (F.col("section_no") == F.col("last")))
    chosen = s.where(front).select("book_id", "section_no", F.lit("front").alias("part")).unionByName(s.where(ending).select("book_id", "section_no", F.lit("ending").alias("part")))
    limit = F.greatest(F.lit(1000), F.floor(F.lit(most) / F.greatest(F.count("*").over(W.partitionBy("book_id")), F.lit(1))))
    chosen = chosen.withColumn("limit", limit)
    rows = paras.join(chosen, ["book_id", "section_no"])
    return excerpt(rows, ["book_id", "part", "section_no"], "idx", "word_count", F.col("limit")).select("book_id", "part", "section_no", "idx", "paragraph_id", "word_count")


def batches(rows: DataFrame, keys: list[str], order: str, size: int, into: str = "batch") -> DataFrame:
    """Adds the number (from 0) of the slice of `size` consecutive rows."""
    return running(rows, keys, order, {"_place": F.lit(1)}).withColumn(into, F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def section_caps(secs: DataFrame, target: Column, priorities: DataFrame | None = None, least: int = 600, high: float = 1.15) -> DataFrame:
    """book_id, section_no, cap: a section's share of the book's target words, at least `least`, more by `high` at high priority."""
    included = secs.where((F.col("kind") != "exclude") & (F.col("word_count") > 0))
    total = F.sum("word_count").over(W.partitionBy("book_id"))
    share = F.col("word_count").cast("double") / total
    cap = F.greatest(F.lit(least).cast("long"), (target.cast("double") * share).cast("long"))
    rows = included.withColumn("cap", cap)
    if priorities is None:
        return rows.select("book_id", "section_no", "cap")
    rows = rows.join(priorities.select("book_id", "section_no", "priority"), ["book_id", "section_no"], "left")
    return rows.select("book_id", "section_no", F.when(F.col("priority") == "high", (F.col("cap") * F.lit(high).cast("double")).cast("long")).otherwise(F.col("cap")).alias("cap"))


def page_edges(lines: DataFrame, top: int = 12, bottom: int = 4) -> DataFrame:
    """The lines at both ends of each page. margin_noise() and page_headings() find in them what they find in all lines, as long as they look
    at no more; whole pages with up to top + bottom lines stay."""
    page = W.partitionBy("book_id", "page_no")
    placed = lines.select("book_id", "page_no", "line_no", "text", F.row_number().over(page.orderBy("line_no")).alias("_down"), F.count("*").over(page).alias("_n"))
    return placed.where((F.col("_down") <= top) | (F.col("_n") - F.col("_down") < bottom)).drop("_down", "_n")


def margin_noise(lines: DataFrame, top: int = 3, bottom: int = 4) -> DataFrame:
    """Keys of short lines that recur at page margins: lines (book_id, page_no, line_no, text) to (book_id, key). On short pages a line
    can count at both ends."""
    page = W.partitionBy("book_id", "page_no")
    placed = lines.select("book_id", "page_no", "text", F.row_number().over(page.orderBy("line_no")).alias("down"), F.count("*").over(page).alias("n"))
    # keys are made for margin lines only, and once: what an explode has made is filtered after it
    ends = placed.withColumn("times", (F.col("down") <= top).cast("int") + (F.col("n") - F.col("down") < bottom).cast("int")).where("times > 0")
    # a long line's key is too long; that is told before it is made
    ends = ends.where(F.col("text").isNotNull() & ~text.has_letters("text", 101))
    keyed = ends.select("book_id", "times", F.explode(F.array(text.repeated_line_key("text"))).alias("key"))
    counts = keyed.where((F.col("key") != "") & (F.char_length("key") <= 100)).groupBy("book_id", "key").agg(F.sum("times").alias("n"))
    pages = lines.groupBy("book_id").agg(F.countDistinct("page_no").alias("pages"))
    least = F.greatest(F.lit(3).cast("long"), (F.col("pages") * F.lit(0.06).cast("double")).cast("long"))
    return counts.join(pages, "book_id").where(F.col("n") >= least).select("book_id", "key")


def outline_sections(outline: DataFrame) -> DataFrame:
    """Bookmarks (book_id, pos, level, title, start_page) to sections: of the levels with three main titles or more the one with most
    (the first on a tie), else all main titles; repeated (title, page) once, by page."""
    kept = outline.withColumn("title", text.normalize("title")).where(text.is_main_title("title"))
    level = W.partitionBy("book_id", "level")
    kept = kept.withColumns({"n": F.count("*").over(level), "first": F.min("pos").over(level)})
    rank = F.dense_rank().over(W.partitionBy("book_id").orderBy((F.col("n") >= 3).desc(), F.when(F.col("n") >= 3, F.col("n")).desc(), F.when(F.col("n") >= 3, F.col("first"))))
    chosen = kept.withColumn("r", rank).where("r = 1")
    once = chosen.groupBy("book_id", "title", "start_page").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(W.partitionBy("book_id").orderBy("start_page", "pos")).cast("long")
    return once.select("book_id", place.alias("pos"), "title", "start_page")


def page_headings(lines: DataFrame, noise: DataFrame, top: int = 12, longest: int = 140, least: int = 3) -> DataFrame:
    """Without an outline: per page the first of its top lines that reads like a heading and is no margin noise; books with fewer than
    `least` such pages have none. (book_id, start_page, title)"""
    place = F.row_number().over(W.partitionBy("book_id", "page_no").orderBy("line_no"))
    rows = lines.withColumn("place", place).where((F.col("place") <= top) & ~text.has_letters("text", longest + 1))
    rows = rows.select("book_id", "page_no", "place", F.explode(F.array(text.normalize_line("text"))).alias("line")).where((F.col("line") != "") & (F.char_length("line") <= longest))
    rows = rows.withColumn("key", F.explode(F.array(text.line_key("line"))))
    rows = rows.join(noise, ["book_id", "key"], "left_anti").where(text.is_main_title("line") | text.is_heading("line"))
    first = rows.groupBy("book_id", F.col("page_no").alias("start_page")).agg(F.min_by("line", "place").alias("title"))
    return first.withColumn("n", F.count("*").over(W.partitionBy("book_id"))).where(F.col("n") >= least).drop("n").select("book_id", "start_page", "title")


def page_ranges(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds end_page: explicit, else the page before the next start, else the last; empty ranges go. outline: book_id, pos, title,
    start_page, end_page (may be null); pages: book_id, pages."""
    following = F.lead("start_page").over(W.partitionBy("book_id").orderBy("pos")) - 1
    # a page number of 0 counts as not given
    rows = outline.withColumn("end_page", F.coalesce(F.nullif("end_page", F.lit(0)), following)).join(pages, "book_id")
    rows = rows.withColumn("end_page", F.least(F.coalesce("end_page", "pages"), F.col("pages")))
    return rows.where("start_page <= end_page").select("book_id", "pos", "title", "start_page", "end_page")


def page_blocks(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Joins page blocks (book_id, page_no, block_no, text) to the ranges that hold them. A range of up to 2^k pages lies in at most two
    buckets of 2^k pages, so it is two rows however long it is; a page is a row for each k in use (there are at most 63), and they meet
    by book, k and bucket. Only the pages' numbers take part in that; their blocks are joined once the ranges of each page are known."""
    rows = ranges.select("book_id", F.col("pos").alias("section_pos"), "title", F.col("start_page").cast("long").alias("_from"), F.col("end_page").cast("long").alias("_to")).where("_from <= _to")
    rows = rows.withColumn("_k", F.expr("CASE WHEN _from = _to THEN 0 ELSE char_length(bin(_to - _from)) END"))
    rows = rows.withColumn("_bucket", F.explode(F.expr("sequence(shiftright(_from, _k), shiftright(_to, _k))")))
    used = sorted(r[0] for r in rows.select("_k").distinct().collect())
    at = blocks.select("book_id", "page_no").distinct().withColumn("_k", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_bucket", F.expr("shiftright(CAST(page_no AS BIGINT), _k)"))
    found = rows.join(at, ["book_id", "_k", "_bucket"]).where("page_no BETWEEN _from AND _to")
    return found.select("book_id", "page_no", "section_pos", "title").join(blocks, ["book_id", "page_no"])

"""Readers: files of a folder or glob, many books a job, to raw blocks (book_id, section_pos, title, block_pos, text, page) and
diagnostics (book_id, title, format, proceed, diagnostics as JSON, error). Formats go by lower-cased suffix."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import structure
from ..operators.scans import freed, written
from . import archives
from .docx import docx_blocks
from .epub import epub_blocks

FORMATS = ("txt", "md", "docx", "epub", "pdf")
BLOCKS = "book_id string, section_pos long, title string, block_pos long, text string, page int"


def files(spark: SparkSession, path: str) -> DataFrame:
    """book_id (the path), stem, suffix, content. Unknown suffixes are kept, with a null format, so that callers can report them."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return raw.select(F.col("path").alias("book_id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.when(suffix.isin(*FORMATS), suffix).alias("format"), "content")


def read_text(found: DataFrame) -> DataFrame:
    """Raw blocks of plain and Markdown text; broken UTF-8 is replaced."""
    lines = F.posexplode(F.split(F.make_valid_utf8(F.col("content").cast("string")), text.LINE_END))
    rows = found.where(F.col("format").isin("txt", "md")).select("book_id", lines.alias("line_no", "line"))
    return structure.section_blocks(structure.segment_lines(rows, text.opens_section))


def read_archives(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw blocks and diagnostics of Word and EPUB files (book_id, stem, format, content)."""
    found = found.where("format IN ('docx', 'epub')")
    kinds = {r[0] for r in found.select("format").distinct().collect()}
    none = lambda schema: found.sparkSession.createDataFrame([], schema)
    epub, about_epub, broken = none(BLOCKS), none("book_id string, title string, proceed boolean, diagnostics string, error string"), none("book_id string, error string")
    docx, failed = none(BLOCKS), none("book_id string, error string")
    if "epub" in kinds:
        entries = written(archives.members(found.where("format = 'epub'")).drop("format"), "members")
        freed(found.sparkSession)
        epub, about_epub = epub_blocks(entries.hint("merge"))
        broken = broken.unionByName(entries.where("error IS NOT NULL").select("book_id", "error"))
    if "docx" in kinds:
        docx, failed, unread = docx_blocks(found.where("format = 'docx'"))
        broken = broken.unionByName(unread)
    if not kinds:
        return docx, found.select("book_id", F.col("stem").alias("title"), "format", F.lit(None).cast("boolean").alias("proceed"), F.lit("{}").alias("diagnostics"), F.lit(None).cast("string").alias("error"))
    broken = broken.withColumnRenamed("error", "broken")
    failed = failed.withColumnRenamed("error", "no_body")
    about = found.select("book_id", "stem", "format").join(about_epub, "book_id", "left").join(failed, "book_id", "left").join(broken, "book_id", "left")
    about = about.select("book_id", F.coalesce("title", "stem").alias("title"), "format", "proceed", F.coalesce("diagnostics", F.lit("{}")).alias("diagnostics"), F.coalesce("broken", "error", "no_body").alias("error"))
    return docx.unionByName(epub), about


class PageExtractor(Protocol):
    """What a PDF library has to give (none is bundled): for a file, its lines and blocks by page and its bookmarks."""

    def __call__(self, content: bytes) -> dict: ...


def read_pages(found: DataFrame, extract: PageExtractor) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """lines, blocks (book_id, page_no, line_no or block_no, text), outline (book_id, pos, level, title, start_page) and images
    (book_id, pages, images). extract() returns {"lines": [[...] per page], "blocks": [[...] per page], "outline": [(level, title, page)], "images": n}."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x = extract(bytes(r.content))
                yield pd.DataFrame([{"book_id": r.book_id, "lines": [list(p) for p in x["lines"]], "blocks": [list(p) for p in x["blocks"]], "outline": [{"level": a, "title": t, "start_page": p} for a, t, p in x.get("outline", [])], "images": x.get("images", 0)}])

    all_ = found.where("format = 'pdf'").select("book_id", "content").mapInPandas(run, "book_id string, lines array<array<string>>, blocks array<array<string>>, outline array<struct<level: int, title: string, start_page: int>>, images long")

    def pages(what: str, n: str) -> DataFrame:
        p = all_.select("book_id", F.posexplode(what).alias("page_no", "all")).withColumn("page_no", F.col("page_no") + 1)
        return p.select("book_id", "page_no", F.posexplode("all").alias(n, "text"))

    outline = all_.select("book_id", F.posexplode("outline").alias("pos", "o")).select("book_id", "pos", "o.*")
    return pages("lines", "line_no"), pages("blocks", "block_no"), outline, all_.select("book_id", F.size("lines").alias("pages"), "images")


def page_sections(lines: DataFrame, blocks: DataFrame, outline: DataFrame, pages: DataFrame, manual: DataFrame | None = None, boilerplate: tuple[str, ...] = ()) -> DataFrame:
    """Raw blocks of paged books: a manual chapter map, else bookmarks, else headings on pages, then cleaned blocks of three words or more."""
    # all lines are read once; what comes of them is small and written, so that nothing after it reads them again
    lines = written(structure.page_edges(lines), "edges")
    noise = written(structure.margin_noise(lines), "noise")
    none = F.lit(None).cast("int").alias("end_page")
    marks = structure.outline_sections(outline).select("book_id", "pos", "title", "start_page", none)
    if manual is not None:
        marks = marks.join(manual.select("book_id").distinct(), "book_id", "left_anti").unionByName(manual.select("book_id", "pos", "title", "start_page", "end_page"))
    seen = structure.page_headings(lines, noise).join(marks.select("book_id").distinct(), "book_id", "left_anti")
    seen = seen.withColumn("key", text.canonical_title("title")).dropDuplicates(["book_id", "key", "start_page"])
    marks = marks.unionByName(seen.select("book_id", F.col("start_page").cast("long").alias("pos"), "title", "start_page", none))
    placed = structure.page_blocks(written(structure.page_ranges(marks, pages), "ranges"), blocks)
    keys = noise.groupBy("book_id").agg(F.collect_set("key").alias("noise"))
    placed = placed.join(keys, "book_id", "left").withColumn("noise", F.coalesce("noise", F.array().cast("array<string>")))
    # made once: what an explode has made is filtered after it
    made = F.explode(F.array(text.clean_block("text", "noise", boilerplate)))
    placed = placed.select("book_id", "section_pos", "title", "page_no", "block_no", made.alias("text")).where(text.has_words("text", 3))
    return placed.select("book_id", "section_pos", "title", (F.col("page_no").cast("long") * 100_000 + F.col("block_no")).alias("block_pos"), "text", F.col("page_no").cast("int").alias("page"))


def read_chapter_map(spark: SparkSession, path: str, book_id: str | None = None) -> DataFrame:
    """A JSON list of {title, start_page, end_page?} objects: book_id, pos, title, start_page, end_page. Entries without a title or
    start page are an error."""
    raw = spark.read.json(path, multiLine=True, schema="title string, start_page int, end_page int").withColumn("pos", F.monotonically_increasing_id())
    if raw.where("title IS NULL OR start_page IS NULL").limit(1).count():
        raise ValueError("every entry of a chapter map needs title and start_page")
    return raw.select(F.lit(book_id).alias("book_id"), "pos", "title", "start_page", "end_page")


def load_books(spark: SparkSession, path: str, extract: PageExtractor | None = None, chapter_map: DataFrame | None = None, boilerplate: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Raw blocks and diagnostics of all files that path names."""
    return read_books(files(spark, path), extract, chapter_map, boilerplate)


def read_books(found: DataFrame, extract: PageExtractor | None = None, chapter_map: DataFrame | None = None, boilerplate: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Raw blocks and diagnostics of files (book_id, stem, format, content). Unsupported ones, and PDFs without an extractor, show in `error`."""
    in_archives, about = read_archives(found)
    blocks = read_text(found).unionByName(in_archives)
    unread = "format IS NULL" if extract else "format IS NULL OR format = 'pdf'"
    plain = lambda df, error: df.select("book_id", F.col("stem").alias("title"), "format", F.lit(None).cast("boolean").alias("proceed"), F.lit("{}").alias("diagnostics"), error.alias("error"))
    about = about.unionByName(plain(found.where("format IN ('txt', 'md')"), F.lit(None).cast("string"))).unionByName(plain(found.where(unread), F.lit("unsupported input type")))
    if extract:
        lines, page_blocks, outline, pages = read_pages(found, extract)
        paged = page_sections(lines, page_blocks, outline, pages, chapter_map, boilerplate)
        blocks = blocks.unionByName(paged)
        words = paged.groupBy("book_id").agg(F.sum(text.word_count("text")).alias("words"))
        pdf = found.where("format = 'pdf'").join(pages, "book_id", "left").join(words, "book_id", "left")
        n = F.coalesce("words", F.lit(0))
        risk = F.when((n < 500) & (F.col("images") > F.col("pages") * 0.5), "high").when((F.col("images") > F.col("pages")) & (n < 5000), "medium").otherwise("low")
        detail = F.to_json(F.struct(F.lit("PDF").alias("format"), "pages", F.col("images").alias("images_shown"), risk.alias("image_risk")))
        about = about.unionByName(pdf.select("book_id", F.col("stem").alias("title"), "format", ((risk != "high") & (n >= 500)).alias("proceed"), detail.alias("diagnostics"), F.when(n == 0, "no outline or no text; give a chapter map or an OCR text layer").alias("error")))
    return blocks, about

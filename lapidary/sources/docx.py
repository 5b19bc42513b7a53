"""Word documents: paragraphs of the body in order (tables are left out), headings by style name or by the heading rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normalize, opens_section
from ..operators.scans import freed, running, written
from .archives import attribute, body_paragraphs, elements, members


def docx_blocks(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks (book_id, section_pos, title, block_pos, text, page), errors (book_id, error) of readable archives, and errors of others. Archives
    (book_id, format, content) are opened again for each part that is asked for, so that their members are not written."""
    member = lambda name: members(found, (name,)).where(F.col("member") == name)
    listed = written(members(found, ()).select("book_id", "error").distinct(), "listed")
    parts = written(elements(member("word/styles.xml")).where("tag IN ('style', 'name')").select("book_id", "n", "parent", "tag", "attributes"), "styles")
    named = parts.where("tag = 'name'").select("book_id", F.col("parent").alias("n"), attribute("val").alias("name"))
    styles = parts.where("tag = 'style'").select("book_id", "n", attribute("styleId").alias("style")).join(named.hint("merge"), ["book_id", "n"])
    styles = styles.groupBy("book_id", "style").agg(F.max_by("name", "n").alias("name"))

    piece = lambda x: F.when(x["tag"] == "t", x["text"]).when(x["tag"] == "tab", "\t").otherwise("\n")
    pieces = F.array_join(F.transform("pieces", piece), "")
    rows = body_paragraphs(member("word/document.xml")).withColumn("text", pieces)
    rows = rows.select("book_id", "p", "style", F.explode(F.array(normalize("text"))).alias("text")).where("p IS NULL OR text <> ''")
    rows = written(rows.withColumn("opens", (F.char_length("text") < 120) & opens_section("text")), "paragraphs")
    freed(found.sparkSession)
    body, rows = rows.where("p IS NULL").select("book_id").distinct(), rows.where("p IS NOT NULL")

    # texts stay where they are until their places are known
    places = rows.select("book_id", "p", "style", "opens").join(styles.hint("merge"), ["book_id", "style"], "left")
    heading = F.lower(F.coalesce("name", "style", F.lit(""))).startswith("heading") | F.col("opens")
    places = places.select("book_id", "p", heading.alias("heading"))
    places = written(running(places, ["book_id"], "p", {"part": F.col("heading").cast("int")}), "places")
    heads = places.where("heading").join(rows.select("book_id", "p", F.col("text").alias("title")), ["book_id", "p"]).select("book_id", "part", "title")
    lines = places.where("NOT heading")
    order = running(lines.select("book_id", F.col("part").cast("long").alias("part")).distinct(), ["book_id"], "part", {"section_pos": F.lit(1).cast("long")})
    sections = written(order.join(heads.hint("merge"), ["book_id", "part"], "left"), "sections")
    place = F.row_number().over(W.partitionBy("book_id", "part").orderBy("p")).cast("long")
    lines = written(lines.withColumn("block_pos", place).join(sections.hint("merge"), ["book_id", "part"]), "lines")
    freed(found.sparkSession)
    blocks = rows.select("book_id", "p", "text").join(lines.hint("merge"), ["book_id", "p"])
    blocks = blocks.select("book_id", "section_pos", F.coalesce("title", F.lit("Opening")).alias("title"), "block_pos", "text", F.lit(None).cast("int").alias("page"))
    failed = listed.where("error IS NULL").select("book_id").join(body, "book_id", "left_anti").withColumn("error", F.lit("ValueError: no document body"))
    return blocks, failed, listed.where("error IS NOT NULL")

"""Driver-side outputs: run folders, resets, text, JSON, DOCX and PDF files of a finished run, on any file system that Spark reaches."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from . import files
from .pipeline import ARTEFACTS

#: Page presets in points (fixed values): 7 x 10 inches, A5, 7.5 x 10.5 inches.
PAGES = {"small-tablet": (504.0, 720.0), "a5": (419.544, 595.296), "large-tablet": (540.0, 756.0)}


def directory_slug(stem: str) -> str:
    slug = re.sub("-{2,}", "-", re.sub(r"[^\w.-]+", "-", stem.strip()).strip("-._"))
    return slug[:80] or "book"


def stem(path: str) -> str:
    name = str(path).rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def run_folder(spark: SparkSession, parent: str, source: str, reuse: bool = False, now: datetime | None = None) -> str:
    """parent itself if reused, else a new folder named by source and time, numbered from 2 if taken."""
    files.make_folder(spark, parent)
    if reuse:
        return str(parent)
    base, n = f"{parent}/{directory_slug(stem(source))}-{(now or datetime.now()):%Y%m%d-%H%M%S}", 1
    while files.exists(spark, path := base if n == 1 else f"{base}-{n}"):
        n += 1
    files.make_folder(spark, path)
    return path


def reset(spark: SparkSession, folder: str) -> None:
    """Deletes what a run writes, answers too, and leaves other files alone."""
    for name in (*ARTEFACTS, "answers", "requests", "schema_faults", "diagnostics", "targets", "caps", "gaps", "texts"):
        files.delete(spark, f"{folder}/{name}")


def export(spark: SparkSession, folder: str, page_size: str = "small-tablet", font_size: int = 14) -> list[str]:
    """Files of each book under folder/texts, one row at a time: Markdown of each rendering, the edition as DOCX and PDF too, and the summary as JSON
    and all paragraphs as JSON lines."""
    out = []

    def put(name: str, data: bytes) -> None:
        out.append(f"{folder}/texts/{name}")
        files.write(spark, out[-1], data)

    for kind in ("edition", "audit", "guide", "structure_report"):
        for r in spark.read.parquet(f"{folder}/{kind}").toLocalIterator():
            name = f"{directory_slug(stem(r.book_id))}.{kind}"
            put(f"{name}.md", r.text.encode())
            if kind == "edition":
                put(f"{name}.docx", docx(r.text))
                put(f"{name}.pdf", pdf(r.text, page_size, font_size))
    for r in spark.read.parquet(f"{folder}/summary").toLocalIterator():
        put(f"{directory_slug(stem(r.book_id))}.summary.json", json.dumps(r.asDict(True), indent=2, ensure_ascii=False, default=str).encode())
    write_lines(spark.read.parquet(f"{folder}/paragraphs"), f"{folder}/texts/paragraphs", ["book_id", "section_no", "idx"])
    return out


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines, sorted by ordinals within the whole table."""
    df.orderBy(*order).write.mode("overwrite").json(path)


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_DOC_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _styled(markdown: str) -> Iterator[tuple[int, str]]:
    """Level (0: text, 1 to 3: headings, 4: a row of stars) and text of each line that says something."""
    for line in markdown.splitlines():
        if line.strip():
            m = re.match(r"(#{1,3}) (.*)", line)
            yield (len(m[1]), m[2]) if m else (4, "· · ·") if line.strip() == "* * *" else (0, line.strip("*"))


def docx(markdown: str) -> bytes:
    """Headings by leading marks, an omission sign for rows of stars, other lines as paragraphs."""
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:rPr><w:b/><w:sz w:val="{40 - 6 * n}"/></w:rPr></w:style>' for n in (1, 2, 3))
    body = []
    for level, text in _styled(markdown):
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level in (1, 2, 3) else ""
        body.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>')
    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/_rels/document.xml.rels", _DOC_RELS)
        z.writestr("word/styles.xml", f"{head}<w:styles {_NS}>{styles}</w:styles>")
        z.writestr("word/document.xml", f"{head}<w:document {_NS}><w:body>{''.join(body)}</w:body></w:document>")
    return out.getvalue()


def _wrapped(text: str, most: int) -> Iterator[str]:
    """Lines of at most `most` characters, broken at blanks where there are any."""
    line = ""
    for word in text.split():
        while len(word) > most:
            room = most - len(line) - bool(line)
            if room > 0:
                line, word = f"{line} {word[:room]}".strip(), word[room:]
            yield line
            line = ""
        if line and len(line) + 1 + len(word) > most:
            yield line
            line = word
        else:
            line = f"{line} {word}".strip()
    if line:
        yield line


def pdf(markdown: str, page_size: str = "small-tablet", font_size: int = 14) -> bytes:
    """A plain PDF in the viewer's own fixed-pitch font (600 thousandths of its size a character, so that lines can be broken exactly), with page
    numbers. Characters outside Western European ones are shown as question marks."""
    width, height = PAGES[page_size]
    margin, pages = 45.0, [[]]
    y = height - margin
    for level, text in _styled(markdown):
        size = font_size * (1.6, 1.3, 1.1)[level - 1] if level in (1, 2, 3) else float(font_size)
        y -= size * (0.9 if level in (1, 2, 3) else 0.4)
        for line in _wrapped(text, max(1, int((width - 2 * margin) / (0.6 * size)))):
            y -= 1.35 * size
            if y < margin:
                pages.append([])
                y = height - margin - 1.35 * size
            x = (width - 0.6 * size * len(line)) / 2 if level == 4 else margin
            pages[-1].append((level in (1, 2, 3), size, x, y, line))
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    quoted = lambda s: b"(" + re.sub(rb"([()\\\\])", rb"\\\1", s.encode("cp1252", "replace")) + b")"
    catalog, tree = add(b""), add(b"")
    fonts = [add(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % name) for name in (b"Courier", b"Courier-Bold")]
    kids = []
    for n, page in enumerate(pages, 1):
        drawn = [*page, (False, 9.0, (width - 5.4 * len(str(n))) / 2, margin / 2, str(n))]
        text = b"\n".join(b"BT /F%d %.2f Tf %.2f %.2f Td %s Tj ET" % (bold, size, x, at, quoted(line)) for bold, size, x, at, line in drawn)
        stream = add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(text), text))
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %.2f %.2f] /Contents %d 0 R /Resources << /Font << /F0 %d 0 R /F1 %d 0 R >> >> >>" % (tree, width, height, stream, *fonts)))
    objects[catalog - 1] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for n, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj\n%s\nendobj\n" % (n, body))
    start = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, catalog, start))
    return out.getvalue()

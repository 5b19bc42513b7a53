"""Archives and XML as rows: one for each text member of an archive, one for each element of an XML member. Parsing a member into rows is all
that Python does; what the rows mean is decided by joins and windows in epub.py and docx.py."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings of members that hold no text.
BINARY = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff", ".ttf", ".otf", ".woff", ".woff2", ".mp3", ".mp4", ".m4a", ".ogg")
MEMBERS = "place int, member string, data string, error string"
ELEMENTS = "n int, parent int, path array<int>, tag string, tags array<string>, attributes map<string,string>, roles array<string>, text string, whole string"
#: Elements whose text with that of all below them is kept (whole); of others only their own.
LABELS = ("a", "text", "title", "meta")


def members(found: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """book_id, format, place, member, data of archives (book_id, format, content); one that cannot be opened or read is a row with an error. Of
    members that are not wanted the data are read and left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["book_id", "format", "place", "member", "data", "error"])
        for batch in batches:
            for book, kind, content in zip(*batch.columns, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for i, name in enumerate(z.namelist()):
                            data = "" if name.lower().endswith(BINARY) else z.read(name)
                            data = data.decode("utf-8", "replace") if data and (wanted is None or name in wanted) else ""
                            yield batch_of([(book.as_py(), kind.as_py(), i, name, data, None)])
                except Exception as e:  # a broken file is reported, not raised: others go on
                    yield batch_of([(book.as_py(), kind.as_py(), -1, None, None, f"{type(e).__name__}: {e}")])

    return found.select("book_id", "format", "content").mapInArrow(run, f"book_id string, format string, {MEMBERS}")


def body_paragraphs(docs: DataFrame) -> DataFrame:
    """book_id, p (number of the element), style, pieces (tag, text) of the paragraphs in the bodies of Word documents (book_id, data): what stands
    in their runs, in order; a row without p for each body. What is no XML has no rows."""
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    of = lambda e, *names: [c for c in e if local(c) in names]

    def rows(book: str, data: str) -> Iterator[tuple]:
        try:
            root = ET.fromstring(data)
        except (ET.ParseError, ValueError):
            return
        numbers = {e: n for n, e in enumerate(root.iter()) if local(e) == "p"}
        for body in of(root, "body") if local(root) == "document" else []:
            yield book, None, None, None
            for p in of(body, "p"):
                styles = [s for pr in of(p, "pPr") for s in of(pr, "pStyle")]
                style = next((v for k, v in styles[0].attrib.items() if k.rsplit("}", 1)[-1] == "val"), "") if styles else None
                runs = [r for c in p for r in (of(c, "r") if local(c) == "hyperlink" else [c]) if local(r) == "r"]
                yield book, numbers[p], style, [{"tag": local(t), "text": t.text or ""} for r in runs for t in of(r, "t", "tab", "br", "cr")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())])))
        for batch in batches:
            for record in batch.to_pylist():
                if found := list(rows(*record.values())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["book_id", "p", "style", "pieces"])

    return docs.select("book_id", "data").mapInArrow(run, "book_id string, p long, style string, pieces array<struct<tag: string, text: string>>")


def elements(docs: DataFrame) -> DataFrame:
    """book_id, member and the elements of XML members (book_id, member, data) in document order: number, number of the parent, those of all
    above it, local names down to it, attributes by local name, role tokens, and text. What is no XML has no rows."""

    def local(e: ET.Element) -> str:
        return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""

    def rows(book: str, member: str, data: str) -> Iterator[tuple]:
        try:
            root = ET.fromstring(data)
        except (ET.ParseError, ValueError):
            return
        waiting = [(root, [], [])]
        n = 0
        while waiting:
            e, path, names = waiting.pop()
            own = [*names, local(e)]
            given = {k.rsplit("}", 1)[-1]: v for k, v in e.attrib.items()}
            roles = [t for k, v in given.items() if k.lower() in ("type", "role") for t in v.lower().replace(":", "-").split()]
            whole = " ".join(e.itertext()) if own[-1] in LABELS else None
            yield (book, member, n, path[-1] if path else None, path, own[-1], own, list(given.items()), roles, e.text or "", whole)
            waiting += [(child, [*path, n], own) for child in reversed(list(e))]
            n += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), strings, pa.map_(pa.string(), pa.string()), strings, pa.string(), pa.string())
        names = ["book_id", "member", *[c.split(" ")[0] for c in ELEMENTS.split(", ")]]
        for batch in batches:
            for record in batch.to_pylist():
                if found := list(rows(*record.values())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return docs.select("book_id", "member", "data").mapInArrow(run, f"book_id string, member string, {ELEMENTS}")


def attribute(name: str) -> Column:
    """An element's attribute, empty if it has none."""
    return F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(""))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolved(base: Column, href: Column) -> Column:
    """The member that a link in a folder of the archive points to."""
    path = F.substring_index(href, "#", 1)
    path = F.when(path.startswith("/") | (base == ""), path).otherwise(F.concat(base, F.lit("/"), path))
    none = F.array().cast("array<string>")
    up = lambda a: (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != "..")
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & up(a), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


def anchor(href: Column) -> Column:
    return F.nullif(F.regexp_extract(href, r"#(.*)\z", 1), F.lit(""))

from __future__ import annotations

import io
import json
import zipfile
from pathlib import Path

import pytest

from lapidary.operators import structure
from lapidary.operators.scans import written
from lapidary.plans import config, files, outputs, pipeline, provider, render
from lapidary.sources import html, loaders
from lapidary.streaming import inbox

LONG = " ".join(["word"] * 300)


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def _epub(spine: dict[str, str], nav: str = "", ncx: str = "") -> bytes:
    items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(spine))
    refs = "".join(f'<itemref idref="i{k}"/>' for k in range(len(spine)))
    extra = ('<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>' if nav else "") + ('<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if ncx else "")
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>My Book</dc:title></metadata><manifest>{items}{extra}</manifest><spine toc="ncx">{refs}<itemref idref="none"/></spine></package>'
    members = {"META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>', "OEBPS/book.opf": opf}
    members |= {f"OEBPS/{n}": f"<html><body>{x}</body></html>" for n, x in spine.items()}
    if nav:
        members["OEBPS/nav.xhtml"] = nav
    if ncx:
        members["OEBPS/toc.ncx"] = ncx
    return _zip(members)


def _page(spark, raw):
    pages = spark.createDataFrame([(1, raw)], "page_id long, html string")
    return [(r.tag, r.text, tuple(r.anchors), r.loose) for r in html.html_blocks(pages).orderBy("seq").collect()]


def test_blocks_by_elements(spark):
    raw = '<nav><p>skip me now</p></nav><div id="a"><span id="b"/><h2>Head</h2>lost text<p id="c">One<br>two <i>three</i>, four</p><ul><li>item one<p>inner one</ul><td>cell one</td><img></div><p epub:type="z:footnotes">' + LONG + "</p>"
    assert [(t, x[:20], a) for t, x, a, _ in _page(spark, raw)] == [("h2", "Head", ("a", "b")), ("p", "One two three, four", ("c",)), ("li", "item one", ()), ("p", "inner one", ()), ("td", "cell one", ()), ("p", LONG[:20], ())]
    rows = html.events(spark.createDataFrame([(1, raw)], "page_id long, html string"), ["page_id"], "html").collect()
    assert [r.words for r in rows if r.kind == "role"] == [["z-footnotes"]] and sum(r.kind == "image" for r in rows) == 1


def test_loose_reading(spark):
    found = _page(spark, "<head><title>The title leaks</title></head><div>Some prose in a div<section>and <b>more</b> of it</section></div><h1>A heading</h1><div>x</div>")
    assert all(loose for *_, loose in found)
    assert found[0][1].startswith("The title leaks")
    assert ("p", "and more of it") in [b[:2] for b in found] and ("h1", "A heading") in [b[:2] for b in found]
    assert _page(spark, None) == []


def test_loose_anchors(spark):
    """Ids lead to the block told next: a wrapper's to the prose that its start ends too, a heading's and a border's to what follows."""
    found = _page(spark, "<div id=a>one two<div id=b>three four <span id=c>five</span></div></div><h2 id=d>Head<a id=e></a></h2>six seven<p id=f>eight nine")
    assert [b[:3] for b in found] == [("p", "one two", ("a", "b")), ("p", "three four five", ("b", "c")), ("h2", "Head", ("d", "e")), ("p", "six seven", ()), ("p", "eight nine", ("f",))]
    # a single word is not told, and its ids go on; references are decoded twice
    found = _page(spark, "<div id=a>one<div id=b>two &amp;amp; three</div></div>")
    assert [b[:3] for b in found] == [("p", "two & three", ("a", "b"))]


def test_rows_of_equal_ids_are_pages_of_their_own(spark):
    pages = spark.createDataFrame([(None, "<p>first page here</p>"), (None, "<p>other page here</p>"), (2**53 + 1, "<p>third page here</p>")], "page_id long, html string")
    assert sorted((str(r.page_id), r.text) for r in html.html_blocks(pages).collect()) == [("9007199254740993", "third page here"), ("None", "first page here"), ("None", "other page here")]


def _docx(paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t[:3]}</w:t></w:r><w:r><w:t>{t[3:]}</w:t></w:r></w:p>' for s, t in paragraphs)
    return _zip({"word/document.xml": f"<w:document {ns}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "word/styles.xml": f'<w:styles {ns}><w:style w:styleId="T1"><w:name w:val="Heading 1"/></w:style></w:styles>'})


def _read_all(spark, books):
    """For each archive of {name: (kind, data)}: its sections [(title, texts)], its row of diagnostics, and these as JSON."""
    found = spark.createDataFrame([(k, "stem", kind, bytearray(data)) for k, (kind, data) in books.items()], "book_id string, stem string, format string, content binary")
    blocks, about = loaders.read_archives(found)
    out: dict = {k: {} for k in books}
    for r in blocks.orderBy("book_id", "section_pos", "block_pos").collect():
        out[r.book_id].setdefault((r.section_pos, r.title), []).append(r.text)
    rows = {r.book_id: r for r in about.collect()}
    assert rows.keys() == books.keys() and all([n for n, _ in own] == list(range(1, len(own) + 1)) for own in out.values())
    return {k: ([(title, texts) for (_, title), texts in out[k].items()], rows[k], json.loads(rows[k].diagnostics)) for k in books}


def _fixed_layout() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(_epub({"a.xhtml": f"<p>{LONG * 2}</p>"}))) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            w.writestr(n, z.read(n).decode().replace("<metadata ", '<metadata><meta property="rendition:layout">pre-paginated</meta></metadata><metadata '))
    return out.getvalue()


@pytest.fixture(scope="module")
def library(spark):
    """Archives of all kinds, read together."""
    nav = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="a.xhtml">First</a></li><li><a href="b.xhtml#x">Second</a><ol><li><a href="b.xhtml#y">Third</a></li></ol></li><li><a href="n.xhtml">Notes</a><ol><li><a href="n2.xhtml">Chapter one</a></li></ol></li></ol></nav><nav epub:type="landmarks"><ol><li><a epub:type="bibliography" href="bib.xhtml">Works</a></li></ol></nav></body></html>'
    spine = {"a.xhtml": f"<p>{LONG}</p>", "b.xhtml": f'<h1 id="x">S</h1><p>in the second</p><p id="y">{LONG}</p>', "n.xhtml": "<p>note number one</p>", "n2.xhtml": "<p>note number two</p>", "n3.xhtml": "<p>a late note</p>", "bib.xhtml": "<p>some old works</p>"}
    ncx = lambda src: f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="{src}"/></navPoint></navMap></ncx>'
    headings = {"f.xhtml": "<p>for my friends</p>", "a.xhtml": f"<p>{LONG}</p>", "h.xhtml": f"<p>dropped before heading</p><h2>Found</h2><p>{LONG}</p>", "c.xhtml": "<p>goes on here</p>"}
    roles = {"a.xhtml": f"<p>{LONG}</p>", "n.xhtml": '<section epub:type="footnotes"><p>note number one</p></section>', "h.xhtml": "<h2>Found</h2><p>still a note</p>"}
    words = _docx([("x", "before all"), ("T1", "The Start"), ("x", "some text"), ("x", "Chapter 2 goes"), ("x", "more text")])
    epubs = {"nav": _epub(spine, nav), "ncx": _epub(headings, ncx=ncx("a.xhtml")), "roles": _epub(roles, ncx=ncx("../OEBPS/./a.xhtml#top")), "images": _epub({"a.xhtml": "<p>two words</p>" + "<img/>" * 9}), "fixed": _fixed_layout(), "broken": b"no zip", "other": _zip({"x.txt": "x"}), "bare": _epub({"a.xhtml": "<p>one</p>"})}
    return _read_all(spark, {k: ("epub", v) for k, v in epubs.items()} | {"words": ("docx", words), "wordless": ("docx", _zip({"x.txt": "x"}))})


def test_epub_by_navigation(library):
    sections, row, d = library["nav"]
    assert (row.title, row.error) == ("My Book", None)
    assert [(t, len(b)) for t, b in sections] == [("First", 1), ("Second", 1), ("Third", 1), ("Notes", 1), ("Notes: Chapter one", 2), ("Notes: Works", 1)]
    assert (d["contents_from"], d["proceed"], d["confidence"], d["members"]) == ("navigation document", True, "high", 6)


def test_epub_by_ncx_headings_and_front_matter(library):
    sections, _, d = library["ncx"]
    assert [(t, len(b)) for t, b in sections] == [("Unmapped front matter", 1), ("One", 1), ("Found", 2)]
    assert d["contents_from"] == "contents file" and d["front_words"] == 3
    assert d["notes"] == ["3 members have no place in the contents"]


def test_epub_roles_and_climbing_links(library):
    """A page's own role names its section; free pages after it go on with it; links climb folders."""
    assert [(t, len(b)) for t, b in library["roles"][0]] == [("One", 1), ("Notes", 2)]


def test_image_books_are_not_trusted(library):
    d = library["images"][2]
    assert d["image_risk"] == "high" and d["proceed"] is False and d["images_shown"] == 9


def test_fixed_layout_is_reported(library):
    d = library["fixed"][2]
    assert d["fixed_layout"] == ["metadata"] and d["image_risk"] == "medium" and d["notes"][-1].startswith("pages are drawn")


def test_archives_that_hold_no_book(library):
    assert library["broken"][1].error.startswith("BadZipFile")
    assert library["other"][1].error == "ValueError: no package document"
    assert library["bare"][1].error == "ValueError: no readable content"
    assert library["wordless"][1].error == "ValueError: no document body"


def test_docx(library):
    sections, row, _ = library["words"]
    assert sections == [("Opening", ["before all"]), ("The Start", ["some text"]), ("Chapter 2 goes", ["more text"])]
    assert (row.title, row.error) == ("stem", None)


@pytest.fixture
def shelf(tmp_path):
    folder = tmp_path / "shelf"
    folder.mkdir()
    (folder / "A.TXT").write_bytes(b"Opening line here\n\n# One\n\nbad \xff byte text\n\nsecond block\n")
    (folder / "b.docx").write_bytes(_docx([("x", "docx text here")]))
    (folder / "c.epub").write_bytes(_epub({"a.xhtml": f"<h1>Start</h1><p>{LONG}</p>"}))
    (folder / "bad.epub").write_bytes(b"no zip")
    (folder / "d.xyz").write_bytes(b"?")
    pages = [[f"Running Head {i}", f"{i} {'Alpha Beta Gamma Delta'.split()[i // 2]} part" if i % 2 else "plain line", "body text goes here", "more body", "tail", "end", f"{i}"] for i in range(1, 9)]
    (folder / "p.pdf").write_text(json.dumps({"lines": pages, "blocks": [["\n".join(p)] for p in pages], "outline": [], "images": 0}))
    return folder


def test_all_formats(spark, shelf):
    def _extract(content: bytes) -> dict:
        return json.loads(content)

    blocks, about = loaders.load_books(spark, str(shelf), _extract)
    name = lambda b: b.rsplit("/", 1)[1]
    got = sorted((name(r.book_id), r.section_pos, r.title, r.block_pos, r.text[:18], r.page) for r in blocks.collect())
    assert [g for g in got if g[0] == "A.TXT"] == [("A.TXT", 1, "Opening", 1, "Opening line here", None), ("A.TXT", 2, "One", 1, "bad byte text", None), ("A.TXT", 2, "One", 2, "second block", None)]
    assert [g[2] for g in got if g[0] == "b.docx"] == ["Opening"] and [g[2] for g in got if g[0] == "c.epub"] == ["Start"]
    pdf = [g for g in got if g[0] == "p.pdf"]
    assert pdf and {g[2] for g in pdf} <= {"1 Alpha part", "3 Beta part", "5 Gamma part", "7 Delta part"}
    assert all("Running" not in g[4] for g in pdf)
    errors = {name(r.book_id): r.error for r in about.collect()}
    assert errors["d.xyz"] == "unsupported input type" and errors["bad.epub"] and errors["A.TXT"] is None
    _, bare = loaders.load_books(spark, str(shelf))
    assert {name(r.book_id) for r in bare.where("error = 'unsupported input type'").collect()} == {"d.xyz", "p.pdf"}


def test_editions_as_parts_of_text(spark, tmp_path):
    """Part files of a book, by name, one after another are its text."""
    lines = [("a", (1, i), f"line {i}" if i % 3 else "") for i in range(1, 400)] + [("a", (0, 0), "# A"), ("a", (2, 0), "end  "), ("a", (2, 1), " "), ("b", (5, 5), "only")]
    df = spark.createDataFrame([(b, list(p), x) for b, p, x in lines], "book_id string, place array<long>, line string")
    render.write_parts(df, str(tmp_path / "parts"), parts=5)
    want = {r.book_id: r.text for r in render.as_text(df).collect()}
    for book in "ab":
        files_ = sorted((tmp_path / f"parts/book_id={book}").glob("part-*"))
        assert "".join(f.read_text() for f in files_) == want[book]
        assert book == "b" or len(files_) > 2


def test_chapter_map(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text(json.dumps([{"title": "A", "start_page": 1}, {"title": "B", "start_page": 5, "end_page": 9}]))
    bad.write_text(json.dumps([{"title": "A"}]))
    assert [(r.title, r.start_page, r.end_page) for r in loaders.read_chapter_map(spark, str(good), "x").orderBy("pos").collect()] == [("A", 1, None), ("B", 5, 9)]
    with pytest.raises(ValueError):
        loaders.read_chapter_map(spark, str(bad))


def test_inbox(spark, shelf, tmp_path):
    for _ in range(2):
        inbox.watch(spark, str(shelf), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/paragraphs"))
    assert got.where("book_id LIKE '%A.TXT'").count() == 3
    why = {r.book_id.rsplit("/", 1)[1]: r.error for r in spark.read.parquet(str(tmp_path / "out/diagnostics")).collect()}
    assert why["d.xyz"] == why["p.pdf"] == "unsupported input type" and why["A.TXT"] is None


def test_whole_run(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    for b in range(2):
        parts = []
        for title in ("Introduction", "Chapter 1: Start", "Chapter 2: More", "Conclusion", "Bibliography"):
            parts += [f"# {title}", *[f"Passage {b} {title} {i} " + "word " * (30 + 7 * i) for i in range(1 if title == "Bibliography" else 8)]]
        (folder / f"book{b}.md").write_text("\n\n".join(parts))
    c = config.Config(input=str(folder), output=str(tmp_path / "out"), bridge_share=0.1, apply_qc=True)
    summary = pipeline.run(spark, c).collect()
    assert len(summary) == 2
    table = lambda n: spark.read.parquet(f"{c.output}/{n}")
    paragraphs = {(r.book_id, r.paragraph_id): r.text for r in table("paragraphs").collect()}
    for r in table("chosen").collect():
        assert r.text == "\n\n".join(paragraphs[r.book_id, p] for p in r.paragraph_ids)  # verbatim
    for s in summary:
        assert 0 < s.selected <= int(s.target * 1.12) and s.missing == []
    order = table("chosen").orderBy("book_id", "reading_pos").collect()
    assert all((a.section_no, a.first_index) <= (b.section_no, b.first_index) for a, b in zip(order, order[1:]) if a.book_id == b.book_id)
    edition = {r.book_id: r.text for r in table("edition").collect()}
    assert all("Bibliography" not in t and "* * *" in t and "*[Leading on] " in t for t in edition.values())
    assert table("map_violations").count() == 0
    assert pipeline.run(spark, config.Config(input=str(folder), output=str(tmp_path / "p"), parse_only=True)).count() == 2
    texts = outputs.export(spark, c.output)
    assert len(texts) == 14 and all(files.exists(spark, f) for f in texts)
    data = {f.rsplit("/", 1)[1]: Path(f).read_bytes() for f in texts}
    assert _read_all(spark, {"e": ("docx", data["book0.edition.docx"])})["e"][0]
    assert data["book0.edition.pdf"].startswith(b"%PDF") and json.loads(data["book1.summary.json"])["missing"] == []
    assert b"How this edition was chosen" in data["book0.audit.md"] and b"## Bridges" in data["book0.audit.md"]
    # a second run asks nothing: its provider cannot answer, and the result is the same
    again = pipeline.run(spark, c, provider.Replay({})).collect()
    assert sorted(map(str, again)) == sorted(map(str, summary))
    outputs.reset(spark, c.output)
    assert not (tmp_path / "out/edition").exists()


def test_provider_retries_and_replay(spark):
    import hashlib

    request = json.dumps({"title": "t"})
    key = hashlib.sha256(json.dumps(["map", {"title": "t"}], sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    df = spark.createDataFrame([("b", 0, request), ("b2", 0, request), ("c", 0, json.dumps({"title": "u"}))], "book_id string, seq long, request string")
    first = provider.answers(df, "map", provider.Replay({key: '{"problem": "p", "odd": 1}'}), 1)
    rows = first.collect()
    assert len(rows) == 2 and [r.answer is None for r in sorted(rows, key=lambda r: r.answer or "")] == [True, False]
    assert "KeyError" in next(r.error for r in rows if r.answer is None)
    known = spark.createDataFrame([(r.hash, r.answer) for r in rows], "hash string, answer string")
    assert [r.answer for r in provider.answers(df, "map", provider.Replay({}), 1, known).collect()] == [None]  # only the one that failed
    found = provider.answered(df, "map", known)
    assert sorted(r.book_id for r in found.collect()) == ["b", "b2"]
    told = {(r.path, r.fault) for r in provider.schema_faults(found, "map").collect()}
    assert told == {("$.odd", "unknown"), *((f"$.{k}", "missing") for k in ("unity", "requirements", "relations", "path"))}
    deep = {"problem": "p", "unity": 3, "path": [], "relations": [{"source": "a", "target": "b", "relation": "likes"}], "requirements": [{"requirement_id": "r", "kind": "evidence", "description": "d", "importance": "essential", "claims": [1], "sections": [], "must": "no", "note": {}}]}
    answers = spark.createDataFrame([("b", 0, json.dumps(deep)), ("b", 1, None), ("b", 2, "[1]"), ("b", 3, "{")], "book_id string, seq long, answer string")
    got = sorted((r.seq, r.path, r.fault[:12]) for r in provider.schema_faults(answers, "map").collect())
    assert got == sorted([(0, "$.unity", "not a string"), (0, "$.relations[0].relation", "not one of d"), (0, "$.requirements[0].claims[0]", "not a string"), (0, "$.requirements[0].must", "not a boolea"), (0, "$.requirements[0].note", "unknown"), (1, "$", "no JSON"), (2, "$", "not an objec"), (3, "$", "no JSON")])
    score = spark.createDataFrame([("b", 0, json.dumps({"scores": [{"block_id": "x", **{k: 4 for k in provider.RUBRIC}, "redundant_with": [], "rationale": ""}]}))], "book_id string, seq long, answer string")
    assert sorted(r.path for r in provider.schema_faults(score, "score").collect()) == ["$.scores[0].context", "$.scores[0].readability"]
    assert [r.a.problem for r in provider.parsed(found, "map").collect()] == ["p"] * 2


def test_hosted_provider():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"output": {"problem": "why"}}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert json.loads(provider.Hosted("some-model", f"http://127.0.0.1:{server.server_port}/")("map", {"title": "t"})) == {"problem": "why"}
    finally:
        server.shutdown()
    assert seen[0]["model"] == "some-model" and seen[0]["input"] == {"title": "t"}
    assert config.problems(config.Config(input="x", model="m")) == ["a model other than offline needs an endpoint"]


def test_pdf_pages_hold_every_line():
    import re

    text = "# Title (one)\n\nWords " + " ".join(f"w{i}" for i in range(900)) + "\n\n* * *\n\n" + "x" * 300 + "\n"
    for size in outputs.PAGES:
        data = outputs.pdf(text, size, 11)
        shown = b" ".join(re.findall(rb"\((.*?)(?<!\\)\) Tj", data)).decode("cp1252")
        assert all(f"w{i}" in shown.split() for i in range(900)) and "Title \\(one\\)" in shown
        assert data.count(b"/Type /Page ") > 1
        at = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
        assert data[at:].startswith(b"xref")
        for n, p in enumerate(re.findall(rb"(\d{10}) 00000 n", data[at:]), 1):
            assert data[int(p) :].startswith(b"%d 0 obj" % n)


def test_config_problems():
    assert config.problems(config.Config(input="x")) == []
    assert any("candidate_ratio" in p for p in config.problems(config.Config(input="x", target_ratio=0.5, candidate_ratio=0.3)))
    with pytest.raises(SystemExit):
        config.parse(["x", "--retries", "0"])
    assert config.parse(["x", "--apply-qc", "--target-ratio", "0.3"]).apply_qc


def test_run_folders(spark, tmp_path):
    from datetime import datetime

    now = datetime(2024, 1, 2, 3, 4, 5)
    first, second = (outputs.run_folder(spark, str(tmp_path), "/x/My Book.epub", now=now) for _ in range(2))
    assert [f.rsplit("/", 1)[1] for f in (first, second)] == ["My-Book-20240102-030405", "My-Book-20240102-030405-2"]
    assert outputs.run_folder(spark, f"{tmp_path}/r", "x", reuse=True) == f"{tmp_path}/r"
    assert all(files.exists(spark, f) for f in (first, second, f"{tmp_path}/r"))


def test_paragraph_ids_of_a_text_book(spark, shelf):
    blocks, _ = loaders.load_books(spark, str(shelf / "A.TXT"))
    assert sorted(r.paragraph_id for r in structure.paragraphs(blocks).collect()) == ["CH001-P0001", "CH002-P0001", "CH002-P0002"]


def test_long_numbers_open_no_section(spark):
    """A line that begins with a card's or account's number is text in every kind of file; a chapter's number and a year still open a section."""
    number, chapter = "4763047826333361 Of one thing and another.", "1984 Begins the second part"
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    word = _zip({"word/document.xml": f"<w:document {ns}><w:body>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in ("Chapter 1", "some words here", number, chapter, "more words here")) + "</w:body></w:document>"})
    plain = f"Chapter 1\n\nsome words here\n\n{number}\n\n{chapter}\n\nmore words here".encode()
    book = _epub({"a.xhtml": f"<h1>Chapter 1</h1><p>some words here</p><p>{number}</p><p>{chapter}</p><p>more words here</p><p>{LONG}</p>"})
    rows = [("a.docx", "a", "docx", word), ("b.txt", "b", "txt", plain), ("c.epub", "c", "epub", book)]
    blocks, _ = loaders.read_books(spark.createDataFrame(rows, "book_id string, stem string, format string, content binary"))
    got = {(r.book_id, r.title, r.text) for r in blocks.collect() if r.text != LONG}
    assert got == {(b, t, x) for b, *_ in rows for t, x in (("Chapter 1", "some words here"), ("Chapter 1", number), (chapter, "more words here"))}


def test_tasks_follow_the_number_of_events(spark, monkeypatch):
    """A task sorts so many events, not a fixed part of the table; the blocks are the same."""
    made = [(i, f"<h1>Title {i}</h1><p>one two {i}</p><div>three four</div>") for i in range(40)]
    df = spark.createDataFrame(made, "page_id long, html string")
    read = lambda: html.html_blocks(df).select("page_id", "seq", "tag", "text", "loose")
    want = sorted(map(tuple, read().collect()))
    monkeypatch.setattr(html, "TASK_EVENTS", 30)
    found = read()
    assert found.rdd.getNumPartitions() >= 12
    assert sorted(map(tuple, found.collect())) == want


def test_text_files_equal_their_sql_on_odd_texts(spark, tmp_path):
    """Texts without a word, lines that read like headings, other line ends and white space: each document is one section, as in the SQL."""
    import duckdb

    from lapidary import oracles, queries

    texts = ["", " ", "one", "\n\n", "two words\n# Notes on it\nmore words", "12 Monkeys and men\nsome words", "Chapter 3\n\n## x y", "#7 Abcdef", " T he start", "one\x85two", "one  two", "a b\rNotes\rc d", "\tIndex of names\n\t \n\t# One two", "plain words here\nand others", "##", "#", "!!\n??", "PART two: x", None] * 11
    rows = [(i, x, "en", "src0", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["text_file_sections"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({oracles.ORACLE_SQL['text_file_sections']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def _written_by(spark, name, sf):
    """MB of tables that a query writes, by their names."""
    from pathlib import Path

    from lapidary import queries
    from lapidary.operators.scans import shared_folder

    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.iterdir())
    queries.QUERIES[name](spark, sf)
    sizes: dict = {}
    for folder in set(root.iterdir()) - before:
        kind = folder.name.rsplit("-", 1)[0]
        sizes[kind] = sizes.get(kind, 0) + sum(f.stat().st_size for f in folder.glob("*.parquet")) / 1e6
    return sizes


def test_word_files_are_written_once(spark):
    """Besides the archives, their texts are written once, as paragraphs: neither members nor elements are."""
    sizes = _written_by(spark, "docx_sections", "/root/testdata/sf0.01")
    assert sum(sizes.values()) < 2.6 * sizes["archives"], sizes


def test_pages_with_enough_words_are_read_once(spark):
    """Only pages with few words in text elements are read loosely; sections are found without texts."""
    sizes = _written_by(spark, "epub_sections", "/root/testdata/sf0.01")
    assert sizes["few"] < sizes["events"] / 5 and sizes["sections"] < sizes["blocks"] / 3, sizes


def test_members_are_not_broadcast(spark):
    """Tables of members and entries are joined by sorting, however small their files are."""
    from lapidary import queries

    blocks, _ = loaders.read_archives(written(queries._archives(spark, "/root/testdata/sf0.001", "epub", True), "archives"))
    assert "BroadcastHashJoin" not in blocks._jdf.queryExecution().executedPlan().toString()

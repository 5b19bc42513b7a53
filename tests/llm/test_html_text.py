from __future__ import annotations

import html
import re

import pytest

from lapidary.llm import html_text as H
from lapidary.llm.html_text import extract, main_text

NAV = '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">About us all</a></li></ul></nav>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p></p> <!-- x", ""),
        (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{NAV}<div class=\"ad\">Buy this now.</div><article><h1>A &amp; B</h1><p><b>One\n two<br>three &lt;x&gt;<p>Four.</article><footer>&copy; me</footer>", "A & B One two three <x> Four."),
        (f"{NAV}<article><p>Text &am", "Text &am"),
        (f"{NAV}<article><p>Text<p clas", "Text"),
        ("<article><p>a</p><div class='ad box'>Ad!</div><p>b</p><section id=comments><p>First!</p></section></article><aside>s</aside>", "a b"),
        ("<div class=ad><p>never closed<article>Body text</article>", "Body text"),
        ("<article>" + "<p>short.</p>" * 3 + "</article>", "short. short. short."),
        ("<div id='cookie-notice'>We use cookies on this site to do a lot of things for you.</div><div class=content><h2>Head</h2><p>" + "Long sentence here. " * 9 + "</p><p>And more text in this paragraph.</p></div><div class='site-footer'>Foot</div>", "Head " + ("Long sentence here. " * 9).strip() + " And more text in this paragraph."),
        ("<div>Home</div><div>Contact</div><p>" + "Long sentence here. " * 9 + "</p><form><p>Your name please</p><input></form>", ("Long sentence here. " * 9).strip()),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_every_article_of_the_table(spark):
    """The tables' pages hold their text in one article element: an independent reading by plain string operations."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        body = r.html.split("<article>", 1)[1].split("</article>")[0] if "<article>" in r.html else ""
        want = " ".join(html.unescape(re.sub(r"<[a-z/][^>]*(>|$)", " ", body)).split())
        assert got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(want)


def test_table_cases(spark):
    df = spark.createDataFrame([(1, None, None, "c"), (1, "u", "<p>x</p>", "c"), (1, "u", "<p>x</p>", "c"), (None, "v", "<article>" + "y " * 200_000 + "</article>", "c")], "page_id long, url string, html string, text string")
    out = extract(df).collect()
    assert sorted(r.n_chars for r in out) == [0, 1, 1, 399_999]
    assert extract(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><meta charset=x><style>p{}</style><script>a='<p>no</p>'</script><body><article><p>Body text.</p></article>", "Body text."),
        ("<head><title>T</title><p>No body tag.</p>", "No body tag."),
        ("<head><title>T<body><article>Body text</article>", "Body text"),
        ("<script>if (a < b) x = 1;<article>Body text</article>", "Body text"),
        *[(f"<{x}><article><p>Body text.</p></article>", "Body text.") for x in ("select", "object", "iframe", "noscript", "svg", "template")],
        ("<select name=a><article><p>Body text.</p></article><select><option>1</select>", "Body text."),
        ("<article>a <select><option>1</select>b <script>'<script'</script>c</article>", "a b c"),
        ("<article>Body<script>cut off", "Body"),
    ],
)
def test_elements_without_end_tag(page, want):
    assert main_text(page) == want


def test_many_unclosed_elements_take_linear_time():
    assert main_text("<article>" + "<object>x " * 100_000 + "</article>") == ("x " * 100_000).strip()


LONG = "Long sentence here, and then some more of it. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # class names that tell of comments, and those that hold them
        (f"<div class='post has-comments'><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class=post><p>{LONG}</p></div><section class=reactions><p>{LONG} I agree.</p></section>", LONG.strip()),
        (f"<div class=post><p>{LONG}</p></div><div class='comment-body'><p>{LONG} I agree.</p></div>", LONG.strip()),
        # a teaser in an article element beside the text
        (f"<div class=text><h1>Title</h1>{f'<p>{LONG}</p>' * 6}</div><aside><article><p>Read this teaser too.</p></article></aside>", " ".join(["Title", *[LONG.strip()] * 6])),
        (f"<div class=text>{f'<p>{LONG}</p>' * 9}</div><article class=x><p>A teaser.</p></article>", " ".join([LONG.strip()] * 9)),
        # a page within a form, one that is a sidebar
        (f"<form><div id=menu><a href=/>Home</a></div><p>Short opening</p><p>{LONG}</p><p>Fin</p></form>", f"Short opening {LONG.strip()} Fin"),
        (f"<div class=sidebar><p>{LONG}</p><div class=ad>Buy it.</div></div>", ""),
        (f"<form><p>{LONG}</p></form><p>Outside.</p>", "Outside."),
        # what is not the article is left out at any length
        (f"<article><p>{LONG}</p><div class=comments>{f'<p>{LONG} I agree.</p>' * 30}</div></article>", LONG.strip()),
        (f"<article><p>{LONG}</p></article><div id=comments>{f'<p>{LONG} I agree.</p>' * 90}</div>", LONG.strip()),
        (f"<article><p>{LONG}</p></article><footer>{LONG * 120}</footer><div style='display:none'>{LONG * 120}</div>", LONG.strip()),
        (f"{NAV}<footer>{LONG * 9}</footer>", ""),
        (f"<article><p>{LONG}</p></article><div class=rail>{LONG * 6}</div>", LONG.strip()),
        (f"<div class=rail>{LONG * 4}</div><article><p>{LONG[:75]}</p></article><section class=thread>{LONG * 4}</section>", LONG[:75].strip()),
        (f"<article><p>{LONG}</p></article>" + "<div><p>One of many lines in a row.</p></div>" * 400, LONG.strip()),
        # short lines of the same container stay, of another one they go
        (f"<body><div>Home</div><p>Short opening</p><p>{LONG}</p><ul><li>Two eggs</li><li>Milk</li></ul><div>Imprint</div></body>", f"Short opening {LONG.strip()} Two eggs Milk"),
        (f"<p>{LONG}</p>" + "<p><a href=x>Link only</a></p>" * 3 + "<p>Fin</p>", f"{LONG.strip()} Fin"),
        # formulas are text
        ("<article><p>So <math><mi>a</mi><mo>+</mo><mn>1</mn><annotation>a+1</annotation></math> it is.</p></article>", "So a+1 it is."),
        ("<article><p>An <a href=x>article's link</a></p><p><a href=y>is its text</a></p></article><p>outside</p>", "An article's link is its text"),
    ],
)
def test_evidence(page, want):
    assert main_text(page) == want


def test_surge_and_dive_by_brute_force():
    """Windows summed one by one: a line is in a block if it weighs something or if one of the lines up to WINDOW - 1 after it does, after
    a line that weighs something and before WINDOW lines that weigh nothing."""
    import random

    rng = random.Random(4)
    for _ in range(300):
        weight = [rng.choice([0, 0, 0, 1, 5, 30, 90]) for _ in range(rng.randint(1, 30))]
        want, i = [], 0
        while i < len(weight):
            if weight[i] == 0:
                i += 1
                continue
            j = i
            while j < len(weight) and any(weight[j : j + 3]):
                j += 1
            want.append((i, j, max(sum(weight[k : k + 3]) for k in range(i, j))))
            i = j
        assert H.blocks_of(H.np.array(weight)) == want


def test_windows_decide_inside_and_outside_articles(monkeypatch):
    """Pages of random lines: kept lines are those of blocks that reach LEAST, by an own reading of the sums."""
    import random

    rng = random.Random(5)
    for article in (True, False):
        for _ in range(40):
            rows = [(rng.choice(["p", "ad"]), rng.choice([3, 30, 90])) for _ in range(rng.randint(1, 25))]
            body = "".join(f"<div class=w><p>{'x' * n}.</p></div>" if kind == "p" else f"<div class=ad><p>{'y' * n}.</p></div>" for kind, n in rows)
            page = f"<article>{body}</article>" if article else f"<body>{body}</body>"
            text = [n + 1 if kind == "p" else 0 for kind, n in rows]
            weight = text
            strong = {k for i, j, most in H.blocks_of(H.np.array(weight)) if most >= H.LEAST for k in range(i, j) if weight[k]}
            if not strong:
                continue
            assert main_text(page) == " ".join("x" * rows[k][1] + "." for k in sorted(strong))


def test_the_window_changes_pages():
    """Adverts part an article's paragraphs: windows of three bridge them, windows of one do not, and one of two leaves out what lies apart."""
    part = lambda n: f"<section><p>{'x' * n}.</p></section>"
    page = f"<article>{part(100)}<div class=ad>Ad!</div>{part(20)}<div class=ad>Ad!</div><div class=ad>Ad!</div>{part(30)}</article>"
    assert main_text(page) == " ".join("x" * n + "." for n in (100, 20, 30))
    assert main_text(page, window=2) == " ".join("x" * n + "." for n in (100, 20))
    assert main_text(page, window=1) == "x" * 100 + "."


def test_pages_of_the_table_without_article_tags(spark):
    """The same text is found when the article element is a plain container."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = sum(main_text(r.html) == main_text(re.sub(r"<(/?)article\b", r"<\1div", r.html)) for r in rows)
    assert same >= 0.99 * len(rows)

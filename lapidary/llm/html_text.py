"""Main text of web pages by the distribution of text over line blocks.

1. Strip markup: a single pass over the tags turns a page into lines, one for each block-level run of text, with character
   references decoded and white space collapsed. Scripts, styles, the head, comments and hidden elements give no text.
2. Leave out what is not the article: lines in a container that names something else (nav, footer, aside, menu ..., or a class, id or role
   that names a menu, notice, advert, sidebar, reader comments ...) and hidden ones weigh nothing, whatever their length. Lines of a form
   count only on a page that has no other text.
3. Weigh lines: inside an article or main element all characters, as an article's links are its text; outside, the characters outside
   links, none if links hold most of the line. The two are two distributions over the same lines.
4. Sum weights over windows of WINDOW lines. The distribution whose highest window is the higher is the text's, an article's windows
   counting PREFER times: an article outweighs longer text beside it, a teaser does not. In it, a surge is where the sum rises from
   nothing, a dive where it is back at nothing, that is, WINDOW lines in a row weigh nothing. Text between a surge and its dive is kept if
   some window in between reaches `least` characters; without such a block, the heaviest one is kept. Lines in between that weigh
   nothing (an advert among paragraphs) are left out.
5. A block that reaches less stays if it shares its container with a kept line. Outside articles, short lines at either end of a kept
   block, without a sentence's end and no headings, go only if they stand in another container than the block's long lines.

Defined results: a null or empty page, or one whose text is all left out, gives an empty string; markup cut off at the end of a page is dropped; an
unclosed boilerplate container ends where an article begins. Of elements without text of their own, those without an end tag end
after their start tag, scripts and the like before the next body, article or main element; the head needs no tags. Pages are
independent, so ties, repeated rows and empty tables need no care; only the id, URL and html columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped

WINDOW, LEAST, SHORT, PREFER = 3, 80, 40, 16

_TAG = re.compile(r"""<(?:(?P<comment>!--)|[!?][^>]*+(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|/?[a-zA-Z][^>]*+(?:>|\Z))""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_BLANK = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "select", "xmp", "noembed", "noframes"}
#: Of _RAW, those whose content is code or plain text, and those that hold none of their own kind.
_CODE = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
_SINGLE = {"select", "iframe", "noscript"}
_BODY = re.compile(r"<(?:body|article|main)\b", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_MATH = {"math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover", "mfenced", "mstyle", "mpadded", "mphantom", "menclose", "mmultiscripts"}
_INLINE |= _MATH
#: Elements that hold text of the container around them.
_PARTS = {"p", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "hgroup", "header", "details", "summary", "address"}
_OTHER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of a class, id or role that name something else than the article.
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay share sharing social related recommended "
    "recommendations widget newsletter subscribe subscription signup login search searchform toolbar pagination pager copyright contentinfo complementary skip".split()
)
_COMMENTS = {"comment", "comments", "disqus", "commentlist", "respond", "reply", "replies", "discussion", "reactions", "responses", "feedback", "guestbook", "talkback"}
#: Words that say that a class tells of comments and does not hold them.
_TELLS = {"has", "no", "with", "without", "show", "hide", "enabled", "disabled", "open", "closed"}
_CONTENT = {"content", "article", "main", "post", "entry", "story", "text", "body", "page", "wrapper", "container", "layout", "has", "with", "no"}


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    other: bool  # in a container of something else than the article
    form: bool
    inside: bool  # in an article or main element
    heading: bool
    container: int


def _other(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element holds something else than the article."""
    if name in _OTHER or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "main", "article"):
        return False
    words: set[str] = set()
    comments = False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role"):
            for token in value.split():
                own = {w.lower() for w in _WORD.findall(token)}
                comments |= bool(own & _COMMENTS) and not own & _TELLS
                words |= own
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value.lower() == "true":
            return True
    if re.search(r"""(?:^|\s)hidden(?=\s|/|$)""", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs), re.I):
        return True
    if comments:
        return True
    found = words & _NAMES
    if in_article and (name in _HEADINGS or name == "header"):
        found -= {"header"}
    return bool(found) and not words & _CONTENT


def _unclosed(page: str, at: int, name: str, open_: int) -> bool:
    """Whether the rest of the page has too few end tags for the elements of a name that are open and that it opens."""
    starts = len(re.findall(rf"<{re.escape(name)}\b", page[at:], re.I))
    return len(re.findall(rf"</{re.escape(name)}\b", page[at:], re.I)) < starts + open_


def lines(page: str) -> list[Line]:
    """The page's blocks of text in order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int]] = []  # name, whether it holds something else, container
    low = forms = inside = links = headings = containers = 0
    parts: list[str] = []
    linked: list[str] = []
    unclosed: set[str] = set()  # names of which no end tag is left

    def flush() -> None:
        if parts:
            text = _BLANK.sub(" ", "".join(parts)).strip()
            if text:
                plain = len(text) - len(_BLANK.sub(" ", "".join(linked)).strip())
                out.append(Line(text, max(0, plain), low > 0, forms > 0, inside > 0, headings > 0, stack[-1][2] if stack else 0))
            parts.clear()
            linked.clear()

    def close(name: str) -> None:
        nonlocal low, forms, inside, links, headings
        k = len(stack) - 1
        while k >= 0 and stack[k][0] != name:
            if name in _INLINE and stack[k][0] not in _INLINE or name in ("p", "li") and stack[k][0] in ("article", "main", "nav", "div", "section", "body"):
                return
            k -= 1
        if k < 0:
            return
        for n, other, _ in stack[k:]:
            low -= other and n != "form"
            forms -= n == "form"
            inside -= n in ("article", "main")
            links -= n == "a"
            headings -= n in _HEADINGS
        del stack[k:]

    def text(s: str) -> None:
        if s:
            s = html.unescape(s)
            parts.append(s)
            if links:
                linked.append(s)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["comment"]:
            k = page.find("-->", at)
            at = k + 3 if k >= 0 else end
            continue
        if not m["name"] or not m[0].endswith(">"):
            continue
        name = m["name"].lower()
        if m["end"]:
            if name not in _INLINE:
                flush()
            close(name)
            continue
        if name in _RAW:
            flush() if name not in ("svg", "canvas", "noscript", "script", "style", "template", "annotation", "annotation-xml") else None
            if not m["attrs"].rstrip().endswith("/") or name != "svg":
                if name not in unclosed:
                    k = re.compile(rf"<(?P<end>/){'?' if name in _SINGLE else ''}{name}\b[^>]*>?", re.I).search(page, at)
                    if k and k["end"]:
                        at = k.end()
                        continue
                    if not k:
                        unclosed.add(name)
                if name in _CODE:
                    k = _BODY.search(page, at)
                    at = k.start() if k else end
            continue
        if name not in _INLINE:
            if name == "br":
                parts.append("\n")
                continue
            flush()
        if name in _VOID or name == "head":
            continue
        if name in ("article", "main"):
            while low or forms:  # a boilerplate container that was never closed ends here
                k, n = next((k, x[0]) for k, x in reversed(list(enumerate(stack))) if x[1])
                if not _unclosed(page, at, n, sum(x[0] == n for x in stack)):
                    break
                close(n)
        elif name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(name)
        other = _other(name, m["attrs"], inside > 0)
        if name in _INLINE or name in _PARTS:
            container = stack[-1][2] if stack else 0
        else:
            containers += 1
            container = containers
        stack.append((name, other, container))
        low += other and name != "form"
        forms += name == "form"
        inside += name in ("article", "main")
        links += name == "a"
        headings += name in _HEADINGS
    flush()
    return out


def window_sums(weight: np.ndarray, window: int) -> np.ndarray:
    """Of the window that begins at each line."""
    return np.convolve(weight, np.ones(window, np.int64))[window - 1 :] if len(weight) else weight


def weights(found: list[Line], window: int = WINDOW) -> tuple[np.ndarray, bool]:
    """What each line weighs in the windows' sums, and whether the text is an article element's."""
    length = np.array([len(x.text) for x in found], np.int64)
    plain = np.array([x.plain for x in found], np.int64)
    inside = np.array([x.inside for x in found], bool)
    usable = np.array([not x.other and not x.form for x in found], bool)
    if not usable.any():
        usable = np.array([not x.other for x in found], bool)
    within = np.where(usable & inside, length, 0)
    outside = np.where(usable & ~inside & (2 * plain > length), plain, 0)
    peak = lambda w: int(window_sums(w, window).max(initial=0))
    article = within.any() and PREFER * peak(within) >= peak(outside)
    return (within if article else outside), bool(article)


def blocks_of(weight: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Surge, dive and largest window sum of each block: from a line that weighs something to where `window` lines weigh nothing."""
    sums = window_sums(weight, window)
    out, i = [], 0
    while i < len(weight):
        if not weight[i]:
            i += 1
            continue
        j = i
        while j < len(weight) and sums[j]:
            j += 1
        out.append((i, j, int(sums[i:j].max())))
        i = j
    return out


def main_text(page: str | None, window: int = WINDOW, least: int = LEAST) -> str:
    """Text between the surge and dive points of a page."""
    found = lines(page or "")
    weight, article = weights(found, window)
    blocks = blocks_of(weight, window)
    if not blocks:
        return ""
    strong = [b for b in blocks if b[2] >= least] or [max(blocks, key=lambda b: weight[b[0] : b[1]].sum())]
    own = {k for i, j, _ in strong for k in range(i, j) if weight[k]}
    ends = ".!?…:;\"'”’)。！？"
    short = lambda k: not found[k].heading and len(found[k].text) < SHORT and found[k].text[-1] not in ends
    places = {found[k].container for k in own if not short(k)} or {found[k].container for k in own}
    kept = set(own)
    for i, j, _ in strong:
        edge = [k for k in range(i, j) if weight[k]]
        for side in (edge, edge[::-1]):
            for k in side:
                if article or not short(k) or found[k].container in places:
                    break
                kept.discard(k)
    kept = kept or own
    kept |= {k for i, j, _ in blocks for k in range(i, j) if weight[k] and found[k].container in places}
    return " ".join(found[k].text for k in sorted(kept))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), window, least) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(rows, run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Main text of web pages by line-block distribution.

The markup is stripped so that each block element becomes a line. Every line has a
weight, the length of its text outside of links, and none if it stands in an element
that holds no main text by its kind (navigation, scripts, ...) or by its name
(sidebar, cookie notice, comments, ...). Sums of the weights over sliding windows of
lines rise at a surge point and fall at a dive point, on every page; the text from the first
surge to the last dive is the main text, with all that lies between, lines of links included.

The body of the text is the innermost element, other than a paragraph, with ``MOST`` of the
weight, unless it is the whole page. Lines of its own before the first surge and after the last
dive are main text too, such as a short conclusion behind a list of links. A stretch between a
surge and a dive outside of the body is left out if it has less than ``STRETCH_SHARE`` of the
heaviest one's weight, as the small print of a page.

Lines in silenced elements take no part in the windows. A line of an ``article`` or ``main``
that has at least half of the page's text weighs ``SURGE`` more, and beside it short lines
weigh nothing.
A name is boilerplate if all of its words are of that kind or go with such words, or if its first or
last word is ``SURE_WORDS``, whatever stands beside it, unless the name says the contrary
(``no-sidebar``).
An element silenced by kind or name is heard after all if the article text that it has is
more than that outside of such elements and no less than half of all text there, or, if
there is no article text outside, if it has ``MOST`` of the page's text; one named after reader
comments only if next to nothing stands outside.
In a form, short lines are the names of fields.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Elements whose contents are raw text, are no main text, or begin a new line.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
DROPPED = RAW | frozenset(
    "head nav footer aside form template svg math object embed canvas audio video select button "
    "option datalist dialog menu map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr input".split()
)
# Elements that a later one of their kind closes, and those inside which it does not look further.
CLOSED_BY_SAME = {"p": frozenset(), "li": frozenset(("ul", "ol")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)),
                  "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")),
                  "option": frozenset(("select",))}
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners breadcrumb breadcrumbs "
    "comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices "
    "footer footnav foot sidebar sidebars menu menus nav navbar navigation topnav subnav promo promos promotion "
    "promoted sponsor sponsored sponsors related recommended recommendations share sharing social newsletter "
    "subscribe subscription signup login popup modal overlay widget widgets masthead topbar toolbar pagination "
    "pager skip".split()
)
# Words that may stand beside those in one name: "site-footer", "sidebar-left".
NAME_WORDS = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer mobile desktop fixed sticky "
    "area bar block box btn button buttons col column container group icons item items links list panel row "
    "section slot text unit wrap wrapper header form posts articles stories content".split()
)
# Words that tell by themselves, at the beginning or the end of a name.
SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist "
    "disqus cookie cookies gdpr notice notices footer sidebar sidebars menu menus navbar navigation promo promos "
    "promoted sponsor sponsored sponsors newsletter pagination pager masthead topbar toolbar popup".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
# Words that turn a name into its contrary.
CONTRARY = frozenset("has no not with without hide hoc".split())
# Blocks that hold a line or a few, and are no body of a text.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption address html".split())
ARTICLE_WORDS = frozenset("entry post article content story section".split())
# Names of their own that say text, whatever other names the element has.
TEXT_NAMES = frozenset("entry post article content story".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split()
)
# Never boilerplate by name: the page itself.
STRUCTURE = frozenset(("html", "body", "article", "main"))

WINDOW = 3
# A window with so much text surges.
SURGE = 60
# A stretch outside of the body with this share of the heaviest one's weight is main text too.
STRETCH_SHARE = 0.05
# An element with so much of the page's text is the page.
MOST = 2 / 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Silent:
    """An element that holds no main text, unless it proves to hold most of it."""

    __slots__ = ("outer", "form", "comments", "mains", "size", "main", "heard")

    def __init__(self, outer: _Silent | None, form: bool, comments: bool, mains: int):
        self.outer = outer
        self.form = form
        self.comments = comments
        # Articles around it, which are none that it holds.
        self.mains = mains
        self.size = self.main = 0
        self.heard = False


class _Line:
    __slots__ = ("pieces", "linked", "silent", "mains", "node")

    def __init__(self, silent: _Silent | None, mains: int, node: int):
        self.pieces: list[str] = []
        self.linked = 0
        self.silent = silent
        self.mains = mains
        self.node = node


def _boilerplate_name(name: str) -> bool:
    """A name of boilerplate words and such that go with them, or one that begins or ends with a sure one."""
    words = [w.lower() for w in _NAME_PART.findall(name)]
    if any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in NAME_WORDS for w in words):
        return True
    return bool(words) and not CONTRARY.intersection(words) and not SURE_WORDS.isdisjoint((words[0], words[-1]))


def _names(attributes: str) -> list[str]:
    found = _ATTRIBUTE.findall(attributes)
    return [each for name, *value in found if name.lower() in ("class", "id") for each in "".join(value).split()]


def _names_comments(attributes: str) -> bool:
    return any(w.lower() in COMMENT_WORDS for name in _names(attributes) for w in _NAME_PART.findall(name))


def _is_boilerplate(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not in_main:
        return True
    if not attributes or tag in STRUCTURE:
        return False
    found = _ATTRIBUTE.findall(attributes)
    names = _names(attributes)
    says_text = any(each.lower() in TEXT_NAMES for each in names)
    if not says_text and any(_boilerplate_name(each) for each in names):
        return True
    for name, double, single, bare in found:
        value = double or single or bare
        name = name.lower()
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id"):
            words = {w.lower() for w in _NAME_PART.findall(value)}
            # The header of the page, not that of an article.
            if "header" in words and not in_main and not words & ARTICLE_WORDS:
                return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def page_lines(page: str) -> tuple[list[tuple[str, int, bool, bool, int]], list[int]]:
    """The lines of a page and its tree of blocks.

    A line: (text, characters in links, not in boilerplate, inside an article, its block). Blocks are
    numbered in the order in which they begin, paragraphs left out; the list has the one around each.
    """
    lines: list[_Line] = []
    # (tag, boilerplate, article, block around it) of each open element.
    stack: list[tuple[str, bool, bool, int]] = []
    parents, node = [0], 0
    silents: list[_Silent] = []
    silent: _Silent | None = None
    links = mains = 0
    line = _Line(None, 0, 0)
    at, end = 0, len(page)

    def finish() -> None:
        nonlocal line
        if line.pieces:
            lines.append(line)
        line = _Line(silent, mains, node)

    def text(piece: str) -> None:
        if piece:
            line.pieces.append(piece)
            if links:
                line.linked += len(piece.strip())

    def pop_to(depth: int) -> None:
        nonlocal silent, links, mains, node
        block = False
        while len(stack) > depth:
            tag, boilerplate, main, node = stack.pop()
            if boilerplate:
                silent = silent.outer
            mains -= main
            links -= tag == "a"
            block = block or tag not in INLINE or boilerplate
        if block:
            finish()

    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        tag = (token.group(2) or "").lower()
        if not tag:
            continue
        if token.group(1):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
            else:
                if tag not in INLINE:
                    finish()
            continue
        attributes = token.group(3) or ""
        if tag in VOID:
            if tag == "br":
                line.pieces.append(" ")
            elif tag not in INLINE:
                finish()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            finish()
            at = close.end() if close else end
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        stop = CLOSED_BY_SAME.get(tag)
        if stop:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if stack[depth][0] in stop:
                    break
        if attributes.rstrip().endswith("/") and tag not in INLINE and not attributes.rstrip().endswith("=/"):
            finish()
            continue
        main = tag in ("article", "main")
        boilerplate = _is_boilerplate(tag, attributes, bool(mains))
        stack.append((tag, boilerplate, main, node))
        if tag not in INLINE and tag not in PARAGRAPHS:
            parents.append(node)
            node = len(parents) - 1
        if boilerplate:
            silent = _Silent(silent, tag == "form", _names_comments(attributes), mains)
            silents.append(silent)
        mains += main
        links += tag == "a"
        if tag not in INLINE or boilerplate:
            finish()
    finish()
    plain = [(" ".join(html.unescape("".join(each.pieces)).split()), each) for each in lines]
    plain = [(words, each) for words, each in plain if words]
    if silents:
        _hear(plain, silents)
    out = []
    for words, each in plain:
        kept, around = True, each.silent
        while around is not None and kept:
            kept = around.heard or (around.form and len(words) - each.linked >= SURGE)
            around = around.outer
        out.append((words, each.linked, kept, bool(each.mains), each.node))
    return out, parents


def _hear(lines: list[tuple[str, _Line]], silents: list[_Silent]) -> None:
    """Marks the elements that are not to be silenced for what they hold."""
    total = outside = articles = 0
    for words, line in lines:
        own = max(0, len(words) - line.linked)
        total += own
        if line.silent is None:
            outside += own
            articles += own * bool(line.mains)
        around = line.silent
        while around is not None:
            around.size += own
            around.main += own * (line.mains > around.mains)
            around = around.outer
    for each in silents:
        each.heard = (each.main > articles and 2 * each.main >= outside) or (
            not articles and total > 0 and each.size >= MOST * total and (not each.comments or total - each.size < SURGE)
        )


def main_text(page: str | None) -> str:
    """The main text: blocks in page order, one a line."""
    every, parents = page_lines(page or "")
    lines = [(words, linked, main, node) for words, linked, kept, main, node in every if kept]
    own = [max(0, len(words) - linked) for words, linked, _, _ in lines]
    inside = sum(n for n, (_, _, main, _) in zip(own, lines) if main)
    if inside and 2 * inside >= sum(own):
        weights = [n + SURGE if main else n * (n >= SURGE) for n, (_, _, main, _) in zip(own, lines)]
    else:
        weights = own
    body = _body(parents, [node for *_, node in lines], weights, [node for *_, node in every])
    # Of a line of the body that is mostly links nothing is told.
    held = [k for k, (words, _, _, node) in enumerate(lines) if body and node in body and 2 * own[k] >= len(words)]
    found = _stretches(weights, max(1, min(SURGE, max(weights, default=0))))
    enough = STRETCH_SHARE * max((weight for weight, _, _ in found), default=0)
    chosen = [(k, k + 1) for k in held if found] + [
        (first, last)
        for weight, first, last in found
        if body is None or weight >= enough or any(lines[k][3] in body for k in range(first, last))
    ]
    if not chosen:
        return ""
    return "\n".join(line[0] for line in lines[min(c[0] for c in chosen) : max(c[1] for c in chosen)])


def _body(parents: list[int], nodes: list[int], weights: list[int], every: list[int]) -> range | None:
    """The innermost block with ``MOST`` of the weight, as the range of blocks in it; None if it is the whole page."""
    weight, count, last = [0] * len(parents), [0] * len(parents), list(range(len(parents)))
    for node, n in zip(nodes, weights):
        weight[node] += n
    for node in every:
        count[node] += 1
    for node in range(len(parents) - 1, 0, -1):
        around = parents[node]
        weight[around] += weight[node]
        count[around] += count[node]
        last[around] = max(last[around], last[node])
    # Those with so much of it lie in each other.
    inmost = max((node for node, n in enumerate(weight) if n and n >= MOST * weight[0]), default=0)
    return range(inmost, last[inmost] + 1) if count[inmost] < len(every) else None


def _stretches(weights: list[int], surge: int) -> list[tuple[int, int, int]]:
    """The stretches from a surge to a dive point: (weight, first line, line after the last).

    A window surges with ``surge``, at a line with weight; text dives where a whole window
    has no weight, and the stretch ends at the last line before with a window that still surges.
    """
    n, found, at = len(weights), [], 0
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    while at < n:
        if sums[at] < surge or not weights[at]:
            at += 1
            continue
        dive = at
        while dive < n and sums[dive]:
            dive += 1
        last = dive
        while last > at + 1 and (weights[last - 1] == 0 or sum(weights[max(at, last - WINDOW) : last]) < surge):
            last -= 1
        found.append((sum(weights[at:last]), at, last))
        at = dive
    return found


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text`` of every row, from its whole html.

    Null, empty and markup-only pages give an empty text. Malformed markup is read as
    browsers do in the main: unclosed elements end where the next block begins, an
    unclosed script runs to the end. Rows that repeat are extracted each; other columns
    are not looked at; an empty table gives an empty result.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h if isinstance(h, str) else None) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})

    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    return plain.mapInPandas(extract, "page_id long, url string, text string")

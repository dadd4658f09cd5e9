"""Text lines of a web page with what its markup says of each: a tolerant reader of tags, character references and blocks.

A line is the text of a block: white space (any that Unicode knows) becomes one space, ends are trimmed, and tags of phrases join on without a space. Scripts, styles, comments and what is
hidden have no text; elements that are menus, headers, footers, sidebars, notices, adverts, forms or reader comments, by their tag, role, class or id, are left out with all in them.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PHRASES = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW_TEXT = set("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = set("link meta noscript script style template".split())
LEFT_OUT = set(
    "aside audio button canvas datalist dialog embed fieldset footer form iframe input map menu nav noembed noframes noscript object optgroup option script select style svg template textarea title video".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
# Words of a class or id that name a part which is not main text, and those that name main text.
PARTS = set(
    """ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu
    menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signup
    sponsor sponsored subscribe subscription toolbar widget widgets""".split()
)
MAIN_TEXT = set("article content entry main post story".split())
#: A word before one of PARTS that tells of the page around, as in has-sidebar.
AROUND = {"has", "is", "no", "with", "without"}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[a-z]+(?=[A-Z])|[A-Z]?[a-z]+|[A-Z]+")
OUT, ARTICLE, MAIN, BODY, HEADER, HEADING, LINK = 1, 2, 4, 8, 16, 32, 64
#: What a page's lines are taken from: an article element, a main element, a part named as content, or the whole body.
KINDS = ("article", "main", "content", "body")


def _marks(tag: str, attributes: str, above: int) -> int:
    """The marks of an element below one with these marks."""
    marks = above | (OUT if tag in LEFT_OUT else ARTICLE if tag == "article" else MAIN if tag == "main" else HEADING if tag in HEADINGS else LINK if tag == "a" else 0)
    header = tag == "header"
    if attributes and not attributes.isspace():
        given = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
        role = given.get("role", "").strip().lower()
        if role == "banner":
            header = True
        elif role in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
            marks |= OUT
        elif role == "main":
            marks |= MAIN
        elif role == "article" or given.get("itemprop", "").lower() == "articlebody":
            marks |= ARTICLE
        if given.get("itemprop", "").lower() == "comment" or given.get("itemtype", "").lower().endswith("comment"):
            marks |= OUT
        if tag not in ("html", "body", "main") and ("class" in given or "id" in given):
            words = [[w.lower() for w in NAME.findall(x)] for x in f"{given.get('class', '')} {given.get('id', '')}".split()]
            named = {w for x in words if not AROUND & {*x} for w in x}
            if tag != "article" and named & PARTS or tag == "article" and named & {"comment", "reply"}:
                marks |= OUT
            elif "header" in named and tag not in HEADINGS and tag != "article":
                header = True
            elif named & MAIN_TEXT:
                marks |= BODY
    if header:
        marks |= HEADER if above & (ARTICLE | MAIN) else OUT
    return marks


def lines_of(html: str) -> list[tuple[str, int, float]]:
    """(text, marks, share of its characters in links) of each line that is not left out, in order."""
    out: list[tuple[str, int, float]] = []
    text: list[str] = []
    linked = marks_of = 0
    stack: list[tuple[str, int]] = [("", 0)]
    open_tags: Counter[str] = Counter()
    at, end, pattern = 0, len(html), TAG

    def said(piece: str) -> None:
        nonlocal linked, marks_of
        marks = stack[-1][1]
        if piece and not marks & OUT and (not marks & HEADER or marks & HEADING):
            piece = unescape(piece)
            text.append(piece)
            if not piece.isspace():
                marks_of |= marks
                linked += len(piece) if marks & LINK else 0

    def finish() -> None:
        nonlocal linked, marks_of
        if text:
            whole = "".join(text)
            if line := " ".join(whole.split()):
                out.append((line, marks_of, linked / len(whole)))
            text.clear()
        linked = marks_of = 0

    def close(tag: str) -> None:
        """Ends the innermost open element of this name; a phrase only within its block."""
        if not open_tags[tag]:
            return
        k = len(stack) - 1
        while stack[k][0] != tag:
            if tag in PHRASES and stack[k][0] not in PHRASES:
                return
            k -= 1
        for name, _ in stack[k:]:
            open_tags[name] -= 1
        del stack[k:]

    while at < end:
        here = html.find("<", at)
        if here < 0:
            said(html[at:])
            break
        said(html[at:here])
        follows = html[here + 1 : here + 3]
        if follows[:1] in "!?" and follows or follows[:1] == "/" and not follows[1:].isalpha():
            comment = html.startswith("<!--", here)
            stop = html.find("-->" if comment else ">", here + (2 if comment else 1))
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        if not (follows[:1].isalpha() and follows[:1].isascii() or follows[:1] == "/"):
            said("<")
            at = here + 1
            continue
        tag = pattern.match(html, here)
        if not tag and pattern is TAG:  # a quote that is never closed: from here on tags end at the first >
            pattern = PLAIN_TAG
            tag = pattern.match(html, here)
        if not tag:
            break
        at, name = tag.end(), tag[2].lower()
        if name not in PHRASES and name not in UNSEEN:
            finish()
        if tag[1]:
            close(name)
            continue
        if name in ENDS_PARAGRAPH and open_tags["p"] and not any(x in ("button", "object", "td", "th", "table") for x, _ in stack[-8:]):
            close("p")
        elif name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == name:
            close(name)
        marks = _marks(name, tag[3], stack[-1][1])
        if name in RAW_TEXT:
            stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            at = stop.start() if stop else end
            if stop:
                stack.append((name, marks | OUT))
                open_tags[name] += 1
        elif name not in VOID and not tag[3].endswith("/"):
            stack.append((name, marks))
            open_tags[name] += 1
    finish()
    return out


def main_lines(html: str) -> tuple[str, list[str]]:
    """What the main text is taken from (of KINDS), and its lines. Outside article and main elements, lines that are links as a whole are left out."""
    found = lines_of(html)
    for kind, mark in (("article", ARTICLE), ("main", MAIN)):
        if some := [line for line, marks, _ in found if marks & mark]:
            return kind, some
    found = [x for x in found if x[2] < 0.9]
    named = [line for line, marks, _ in found if marks & BODY]
    if 2 * sum(map(len, named)) >= sum(len(x[0]) for x in found) and named:
        return "content", named
    return "body", [x[0] for x in found]

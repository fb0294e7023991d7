"""Leaf text blocks of web pages with their tag paths, and pages made from them for training."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

#: Elements whose content is never text of the page; script and style run to the end where they are not closed.
RAW = "noscript|template|title|textarea|select|svg|iframe|canvas"
#: Tags that start a part of the page: they end a head, and what else of RAW has no closing tag.
PARTS = ("body|address|article|aside|blockquote|center|details|dialog|dd|dir|div|dl|dt|fieldset|figcaption|figure|footer|"
         "form|h[1-6]|header|hgroup|hr|li|main|menu|nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul")
_PART = re.compile(PARTS)
_START = re.compile(rf"</?(?:{PARTS})(?=[\s/>])", re.I)
_HIDDEN, _RAW = frozenset(("script", "style")), frozenset(RAW.split("|"))
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Before an attribute; its name; up to its value; a value without quotes.
_GAP, _KEY, _IS, _BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr img br input button object math maction "
                   "annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
                   "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
                   "munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, up to the nearest of the second list.
CLOSES = {"p": ({"p"}, set()), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}),
          "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
          "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
#: These end an open paragraph.
BREAK_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                    "h5 h6 header hr main nav ol pre section table ul".split())


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int


class _Scanner:
    """The tags of a page one after the other, by the states of HTML's tokenizer; every step goes forward.

    Quotes count only where a value starts.  A quote that is never closed
    belongs to a value without quotes; if quotes hide every later ``>``, tags end at
    the next one from there on.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}
        self.loose = False
        self.never_closed: set[str] = set()
        self.next_part = -1

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, closing, attributes); comments have no name, skipped elements have the name ``@raw``."""
        page, at = self.page, 0
        while at <= self.last["<"]:
            at = page.find("<", at)
            if at > self.last[">"] and not page.startswith(("<!", "<?"), at):
                # No tag can end any more; a comment may run to the end of the page.
                at += 1
                continue
            if page.startswith(("<!", "<?"), at) or (
                    page.startswith("</", at) and not page[at + 2:at + 3].isalpha() and at + 2 < len(page)):
                end = self._comment(at)
                yield at, end, "", False, ""
                at = end
                continue
            closing = page.startswith("/", at + 1)
            name = _TAG_NAME.match(page, at + 1 + closing)
            if name is None or self.last[">"] < name.end():
                at += 1
                continue
            end = self._tag_end(name.end())
            tag = name.group().lower()
            rest = page[name.end():end - 1]
            if not closing and (tag in _HIDDEN or tag in _RAW):
                end = self._skipped(tag, end)
                yield at, end, "@raw", False, ""
            else:
                yield at, end, tag, closing, rest
            at = end

    def _comment(self, at: int) -> int:
        page, end = self.page, -1
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                return page.index(">", at + 4) + 1
            end, width = page.find("-->", at + 4), 3
        elif page.startswith("<![CDATA[", at):
            end, width = page.find("]]>", at), 3
        else:
            end, width = page.find(">", at), 1
        return end + width if end >= 0 else len(page)

    def _tag_end(self, at: int) -> int:
        page, name_end = self.page, at
        while not self.loose:
            at = _GAP.match(page, at).end()
            if at > self.last[">"]:
                self.loose = True
                break
            if page[at] == ">":
                return at + 1
            at = _KEY.match(page, at).end()
            value = _IS.match(page, at)
            if value is None:
                continue
            at = value.end()
            quote = page[at:at + 1]
            if quote in ("'", '"') and self.last[quote] > at:
                at = page.index(quote, at + 1) + 1
            else:
                at = _BARE.match(page, at).end()
        return page.index(">", name_end) + 1

    def _skipped(self, tag: str, at: int) -> int:
        """Where an element ends whose content is no text: after its closing tag, or at the next part of the page."""
        if tag not in self.never_closed:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at)
            if close and self.last[">"] >= close.end():
                return self._tag_end(close.end())
            self.never_closed.add(tag)
        if tag in _HIDDEN:
            return len(self.page)
        if self.next_part < at:
            part = _START.search(self.page, at)
            self.next_part = part.start() if part else len(self.page)
        return self.next_part


def _names(tag: str, rest: str) -> tuple[str, ...]:
    """Tokens of an element: its tag, and class, id and role names cut into words."""
    out = [tag]
    if rest and rest.strip():
        for key, value in _ATTRIBUTE.findall(rest):
            key = key.lower()
            if key == "hidden" or (key == "aria-hidden" and "true" in value) or (
                    key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                out.append("@hidden")
            elif key in ("class", "id", "role"):
                out += ["." + w.lower() for w in _NAME.findall(value)]
    return tuple(out)


def leaf_blocks(page: str | None) -> list[Block]:
    """Texts between block-level tags in page order; white space is one blank, references are decoded."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, in_link, in_head = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(tuple(t for _, names in stack for t in names), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop_to(index: int) -> None:
        flush()
        del stack[index:]

    at = 0
    for start, end, tag, closing, rest in _Scanner(page).tags():
        if start > at and in_head and not page[at:start].isspace():
            # Text ends a head that is still open.
            in_head = False
        if start > at and not in_head:
            piece = page[at:start]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        at = end
        if not tag or tag == "@raw":
            if tag:
                pieces.append(" ")
            continue
        if in_head:
            # The closing tag of a head may be left out.
            in_head = not (closing and tag == "head" or _PART.fullmatch(tag))
            if in_head:
                continue
        elif tag == "head" and not closing:
            flush()
            in_head = True
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        in_link = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            else:
                flush()
            continue
        flush()
        ends, until = CLOSES.get(tag, ({"p"}, set()) if tag in BREAK_P else (set(), set()))
        if ends:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in ends:
                k -= 1
            if tag in CLOSES and tag != "p":
                j = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][0] in until), -1)
                k = next((i - 1 for i in range(j + 1, len(stack)) if stack[i][0] in ends), len(stack) - 1)
            del stack[k + 1:]
        if tag not in VOID and not rest.rstrip().endswith("/"):
            stack.append((tag, _names(tag, rest)))
    if at < len(page) and not (in_head and page[at:].isspace()):
        pieces.append(page[at:])
    flush()
    return out


#: Path tokens that say by themselves what a part of a page is: weak labels for training.
MAIN_PARTS = frozenset({"article", "main"})
OTHER_PARTS = frozenset("nav footer aside form header .ad .ads .advert .comments .comment .sidebar .cookie .notice "
                        ".menu .footer @hidden".split())


def weak_label(block: Block) -> int:
    path = set(block.path)
    return int(bool(path & MAIN_PARTS) and not path & OTHER_PARTS)


_SHELLS = {
    "header": ["<header>", "<header class='site-header'>", "<div class='masthead'>", "<div id='header'>",
               "<div class='top-bar'>", "<div class='branding'>"],
    "nav": ["<nav>", "<nav class='main-nav'>", "<div class='menu'>", "<div id='navigation'>", "<div class='navbar'>",
            "<div class='breadcrumbs'>", "<div role='navigation'>"],
    "notice": ["<div class='notice'>", "<div class='cookie-banner'>", "<div role='alert'>", "<div id='consent'>",
               "<section class='alert notification'>", "<div class='disclaimer'>", "<div class='gdpr popup'>"],
    "ad": ["<div class='ad'>", "<div class='advert'>", "<div class='ads sponsored'>", "<div class='promo'>",
           "<aside class='advertisement'>", "<div id='banner-ad'>", "<section class='sponsor'>"],
    "sidebar": ["<aside>", "<aside class='sidebar'>", "<div class='sidebar'>", "<div id='sidebar'>",
                "<div class='widget related'>", "<section class='related-posts'>", "<div class='trending'>"],
    "form": ["<form>", "<form class='search'>", "<form id='newsletter'>", "<form action='/login'>",
             "<div class='subscribe-form'>"],
    "comments": ["<section class='comments'>", "<div id='comments'>", "<div class='comment-list'>",
                 "<ol class='commentlist'>", "<section id='responses'>", "<div class='discussion replies'>"],
    "footer": ["<footer>", "<footer class='site-footer'>", "<div class='footer'>", "<div id='footer'>",
               "<div class='copyright'>", "<div role='contentinfo'>"],
    "main": ["<article>", "<article class='post'>", "<main>", "<div class='content'>", "<div id='content'>",
             "<div class='article-body'>", "<div class='entry-content'>", "<section class='story'>", "<div role='main'>",
             "<article id='story'>", "<div class='text body'>"],
}
_INSIDE = {
    "main": ["<p>", "<p>", "<p>", "<p>", "<p>", "<li>", "<blockquote>", "<h2>", "<h3>", "<td>", "<pre>", "<div>"],
    "nav": ["<li>", "<li>", "<a href='/'>", "<p>"], "footer": ["", "<p>", "<small>", "<li>"],
    "header": ["", "<h2>", "<p>", "<div>", "<h1>"], "form": ["<label>", "<p>", "<button>", "<legend>", "<div>"],
    "comments": ["<p>", "<div class='comment'>", "<li>", "<blockquote>"], "ad": ["", "", "<p>", "<div>"],
    "notice": ["", "<p>", "<div>"], "sidebar": ["<li>", "<p>", "<h3>", "", "<div>"],
}


#: Words of one block of a made page, at most; a sampled text may be a whole book.
MADE_WORDS = 200


def _end(opening: str) -> str:
    return f"</{opening[1:].split()[0].rstrip('>')}>" if opening else ""


def made_page(rng: random.Random, main: list[str], other: list[str]) -> list[tuple[Block, int]]:
    """Blocks and labels of a page put together from texts: parts in usual order, some in the article."""
    def part(kind: str) -> str:
        shell = rng.choice(_SHELLS[kind])
        source = main if kind in ("main", "comments", "sidebar") or rng.random() < 0.4 else other
        n = {"main": rng.randint(1, 14), "nav": rng.randint(2, 8), "comments": rng.randint(1, 7)}.get(
            kind, rng.randint(1, 4))
        mark = "\x01" if kind == "main" else "\x02"
        body = []
        if kind == "main" and rng.random() < 0.8:
            body.append(f"<h1>{mark}{html.escape(' '.join(rng.choice(main).split()[:9]))}</h1>")
        for _ in range(n):
            inner = rng.choice(_INSIDE[kind])
            words = rng.choice(source).split(maxsplit=MADE_WORDS)[:MADE_WORDS]
            if kind in ("nav", "header", "footer", "form") or (kind == "sidebar" and rng.random() < 0.5):
                words = words[:rng.randint(1, 8)]
            text = mark + html.escape(" ".join(words))
            if kind == "nav":
                text = f"<a href='/x'>{text}</a>"
            if kind == "footer" and rng.random() < 0.5:
                text = mark + "&copy; " + text.strip("\x02")
            body.append(inner + text + _end(inner))
            if kind == "main" and rng.random() < 0.08:
                body.append(part(rng.choice(["ad", "sidebar", "form", "notice"])))
        return shell + "".join(body) + _end(shell)

    parts = [part(k) for k in ("header", "nav", "notice", "ad", "sidebar") if rng.random() < 0.5]
    rng.shuffle(parts)
    parts.append(part("main"))
    parts += [part(k) for k in ("ad", "sidebar", "form", "comments", "notice", "footer") if rng.random() < 0.5]
    if rng.random() < 0.4:
        parts = [rng.choice(["<div class='page'>", "<div id='wrapper'>", "<div class='container'>"]), *parts, "</div>"]
    out = []
    for block in leaf_blocks("<html><body>" + "".join(parts) + "</body></html>"):
        label = int("\x01" in block.text)
        text = " ".join(block.text.replace("\x01", " ").replace("\x02", " ").split())
        if text:
            out.append((block._replace(text=text, linked=min(block.linked, len(text))), label))
    return out

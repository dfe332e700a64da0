"""HTML as a sequence of text blocks: every block knows its path of tags, and how much of it is link text.

A block is the text between two boundaries of block-level elements. Scripts, styles, titles and comments hold no text;
formulas are text inside their line. Missing end tags are implied as browsers do: a block opens after an open paragraph is
closed, an end tag closes everything inside its element, stray end tags are ignored. The head needs no end tag, as what it
holds is skipped by itself. An element without text whose end tag is missing ends where its parent ends or a block opens;
only scripts and styles go on to the end of the page then.
"""

from __future__ import annotations

import html
import re
from collections import Counter

#: Elements without content, elements that stay inside a line, elements whose content is not text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr "
                   "math semantics maction menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot "
                   "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split())
RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml textarea select option button title noframes".split())
#: Of these, the ones that do not end a block.
QUIET = frozenset("script style noscript template annotation annotation-xml".split())
#: Elements that end an open RAW element without an end tag.
FLOW = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                 "hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_REST = r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)" + _REST, re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[A-Za-z]+")


def path_names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and each word of its class, id and role."""
    names = [tag]
    if attributes:
        for _, value in _ATTRIBUTE.findall(attributes):
            names += ["." + w.lower() for w in _NAME.findall(value)]
    return tuple(names)


def ends_of(page: str, tag: str) -> dict[int, int]:
    """Of every start tag of ``tag`` that has its end tag: the place behind it, and the place behind the end tag."""
    if tag in ("script", "style"):  # up to the next end tag, whatever is inside, or to the end of the page
        out, at = {}, 0
        start, end = re.compile(f"<{tag}(?=[\\s/>])" + _REST, re.I), re.compile(f"</{tag}\\s*>", re.I)
        while m := start.search(page, at):
            done = end.search(page, m.end())
            at = out[m.end()] = done.end() if done else len(page)
        return out
    out, opened = {}, []
    for m in re.finditer(f"<(/?){tag}(?=[\\s/>])" + _REST, page, re.I):
        if not m[1]:
            if not m[2].rstrip().endswith("/"):
                opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def leaves(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(names on the path, text, share of link text) of every block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter = Counter()  # elements of the stack by tag, so that an end tag need not look for its start
    text: list[str] = []
    linked = 0
    path: tuple[str, ...] | None = None
    hidden: int | None = None  # place in the stack of an open RAW element without an end tag
    ends: dict[str, dict[int, int]] = {}

    def push(tag: str, names: tuple[str, ...]):
        stack.append((tag, names))
        opened[tag] += 1

    def cut(k: int):
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def flush():
        nonlocal text, linked, path
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((path, line, min(1.0, linked / len(line))))
        text, linked, path = [], 0, None

    def add(piece: str):
        nonlocal linked, path
        if not piece or hidden is not None:
            return
        if path is None and not piece.isspace():
            path = tuple(n for tag, names in stack if tag not in INLINE for n in names)
        text.append(piece)
        if opened["a"]:
            linked += len(piece)

    at = 0
    last = page.rfind(">")
    while at <= last and (m := _TAG.search(page, at)):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if opened[tag]:
                if tag not in INLINE:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                cut(k)
                if hidden is not None and len(stack) <= hidden:
                    hidden = None
            elif tag == "p":
                flush()
            continue
        if hidden is not None and tag in FLOW:
            cut(hidden)
            hidden = None
        if tag == "head":
            flush()
            continue
        if tag in RAW:
            if tag not in QUIET:
                flush()
            if m[3].rstrip().endswith("/") and tag not in ("script", "style"):
                continue
            if tag not in ends:
                ends[tag] = ends_of(page, tag)
            if at in ends[tag]:
                at = ends[tag][at]
                continue
            if tag in ("script", "style"):
                end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if hidden is None:
                hidden = len(stack)
                push(tag, (tag,))
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag == "p" or tag not in ("td", "th", "tr", "li", "dd", "dt"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        cut(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        cut(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead"):
                        break
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            push(tag, path_names(tag, m[3]))
    add(page[at:])
    flush()
    return out

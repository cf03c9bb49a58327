"""A page as a flat tree of blocks: a small, forgiving reader of raw HTML.

Tags, quoted attributes, comments, raw-text elements, implied end tags and unclosed or truncated markup
are understood. Only blocks become nodes; inline elements shape the text runs between them, which
are the leaves. Nothing of the page's text is dropped or cut: what is invisible by definition (scripts,
styles, titles and the like) is no run.
"""

from __future__ import annotations

import html
import re

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp textarea title svg math object canvas audio video".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul "
    "select optgroup option button".split()
)
#: Elements that an opening tag ends, and the elements that shield them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"caption", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"caption", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"caption", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SHIELD = frozenset("table td th caption button html body".split())
#: As in browsers, blocks nested deeper than this stay open at this depth; their text is kept.
DEPTH = 512
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NO_P = frozenset("html body td th tr thead tbody tfoot caption colgroup option optgroup select button legend summary".split())

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attribute_tokens(raw: str) -> tuple[str, ...]:
    """Lower-case words of class, id, role and item names, and marks of hidden elements."""
    if not raw or raw.isspace():
        return ()
    out: list[str] = []
    for name, *values in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role", "itemprop", "itemtype", "aria-label", "data-role", "data-component", "data-testid", "property"):
            out += [w.lower() for w in _NAMES.findall(html.unescape(value)) if len(w) > 1]
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            out.append("+hidden")
    return tuple(dict.fromkeys(out))


class Page:
    """Nodes in page order: ``tag`` ('' for a text run), ``parent`` (-1: the page), ``tokens``, ``text``, ``link_chars``, ``links``, ``controls``."""

    __slots__ = ("tag", "parent", "tokens", "text", "link_chars", "links", "controls", "marks")

    def __init__(self):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.tokens: list[tuple[str, ...]] = []
        self.text: list[str] = []
        self.link_chars: list[int] = []
        self.links: list[int] = []
        self.controls: list[int] = []
        self.marks: list[str] = []  # what a test or trainer wrote into data-mark

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = ()) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append("")
        self.link_chars.append(0)
        self.links.append(0)
        self.controls.append(0)
        return len(self.tag) - 1


def read(source: str | None) -> Page:
    """The tree of a page; a null or empty page has no node."""
    page = Page()
    if not source:
        return page
    stack: list[int] = [-1]  # open blocks
    pieces: list[str] = []  # the text run being read
    state = {"link": 0, "links": 0, "chars": 0, "anchor": 0}

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            i = page.add("", stack[-1])
            page.text[i], page.link_chars[i], page.links[i] = text, min(state["chars"], len(text)), state["links"]
        state["chars"] = state["links"] = state["anchor"] = 0

    def words(a: int, b: int) -> None:
        if a < b:
            t = source[a:b]
            if "&" in t:
                t = html.unescape(t)
            pieces.append(t)
            if state["anchor"]:
                state["chars"] += len(t)

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    def opened(names: set[str], shield) -> int:
        """Place of the innermost open block of these names inside the shield, 0 if none."""
        for at in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[at]]
            if tag in names:
                return at
            if tag in shield:
                return 0
        return 0

    at, end = 0, len(source)
    while at < end:
        m = _MARKUP.search(source, at)
        if m is None:
            words(at, end)
            break
        words(at, m.start())
        at = m.end()
        if m.group(1):
            name = m.group(1).lower()
            if name == "a":
                state["anchor"] = 0
            elif name in BLOCK:
                depth = opened({name} if name not in HEADINGS else set(HEADINGS), SHIELD if name not in SHIELD and name not in ("table", "tr", "tbody", "thead", "tfoot") else ())
                if depth:
                    close(depth)
                elif name == "p":
                    flush()
            elif name in ("br",):
                pieces.append(" ")
            continue
        name = m.group(2)
        if not name:
            continue
        name, raw = name.lower(), m.group(3) or ""
        if name in RAW:
            if not raw.endswith("/") or name not in ("svg", "math"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else end
            if name == "textarea" and len(stack) > 1:
                page.controls[stack[-1]] += 1
        elif name == "br":
            pieces.append(" ")
        elif name == "input" or name == "label":
            if len(stack) > 1:
                page.controls[stack[-1]] += 1
        elif name == "a":
            state["anchor"] = 1
            state["links"] += 1
        elif name in BLOCK:
            if name in ("html", "body") and any(page.tag[i] == name for i in stack[1:]):
                continue
            flush()
            if name in ENDS:
                depth = opened(*ENDS[name])
                while depth:  # a row also ends the cell that is open inside it
                    close(depth)
                    depth = opened(*ENDS[name])
            if name not in _NO_P:
                depth = opened({"p"}, SHIELD)
                if depth:
                    close(depth)
            if name in HEADINGS and len(stack) > 1 and page.tag[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
            node = page.add(name, stack[-1], attribute_tokens(raw))
            mark = re.search(r'data-mark="(\w+)"', raw) if "data-mark" in raw else None
            if mark:
                page.marks.extend([""] * (node + 1 - len(page.marks)))
                page.marks[node] = mark.group(1)
            if name in ("button", "select", "option"):
                page.controls[node] += 1
            if name != "hr" and len(stack) <= DEPTH:
                stack.append(node)
    flush()
    return page

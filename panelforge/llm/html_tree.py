"""A forgiving HTML reader: block-level elements as a tree, with the text that each holds directly."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe title textarea".split())  # raw text up to the end tag, or to the page's end
HIDDEN = frozenset("template svg".split())  # their insides aren't page text, if they end
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br img input button select option output picture audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
WALLS = frozenset("html body table td th ul ol dl article aside section div main nav header footer form figure".split())
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("attrs", "blocks", "children", "controls", "depth", "images", "link_chars", "parent", "tag")

    def __init__(self, tag: str, parent: int, depth: int, attrs: str) -> None:
        self.tag, self.parent, self.depth, self.attrs = tag, parent, depth, attrs
        self.blocks: list[int] = []
        self.children = self.link_chars = self.controls = self.images = 0


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def read(html: str | None) -> tuple[list[Node], list[str]]:
    """(nodes in page order, the root first; texts of the blocks in page order). A node's `blocks` are places in the
    texts. White space in a block is one space each; blocks without text are left out."""
    nodes, texts = [Node("#root", -1, 0, "")], []
    if not html:
        return nodes, texts
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their nodes; inline ones have the node around them
    pieces: list[str] = []
    owner, links = 0, 0

    def flush() -> None:
        nonlocal pieces
        if pieces:
            if text := " ".join("".join(pieces).split()):
                nodes[owner].blocks.append(len(texts))
                texts.append(text)
            pieces = []

    def close(depth: int) -> None:
        """Closes open elements until `depth` are left."""
        nonlocal owner, links
        while len(stack) > depth:
            tag, node = stack.pop()
            if tag == "a":
                links -= 1
            if tag not in INLINE:
                flush()
                owner = stack[-1][1]

    def add_text(raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links > 0:
            nodes[owner].link_chars += len(text)

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add_text(html[at:])
            break
        if m.start() > at:
            add_text(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        tag, ends = name.lower(), m["end"] or m["end2"]
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] in WALLS:
                    break
            if tag == "p" or tag in CLOSES_P:
                flush()
            continue
        if tag in ("svg", "math") and (m["attrs"] or m["attrs2"] or "").rstrip().endswith("/"):
            continue
        if tag in RAW or tag in HIDDEN:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n if tag in RAW else at
            if tag == "textarea":
                nodes[owner].controls += 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in ("input", "button", "select", "textarea"):
            nodes[owner].controls += 1
        if tag == "img":
            nodes[owner].images += 1
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in WALLS:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SIBLINGS[tag]:
                    close(k)
                    if tag in ("li", "dt", "dd"):
                        break
                elif stack[k][0] in WALLS:
                    break
        if tag in INLINE:
            stack.append((tag, owner))
            links += tag == "a"
            continue
        if tag in ("html", "body", "head") and any(t == tag for t, _ in stack):
            continue
        flush()
        around = nodes[owner]
        around.children += 1
        nodes.append(Node(tag, owner, around.depth + 1, m["attrs"] or m["attrs2"] or ""))
        owner = len(nodes) - 1
        stack.append((tag, owner))
    close(1)
    flush()
    return nodes, texts

"""A small HTML tree and its skeleton of blocks, whose nodes get paths by alignment with other pages."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Element kinds of HTML, and names by which pages mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption".split()
)
UNWANTED = frozenset(
    "head title script style noscript template iframe nav header footer aside form button select textarea input label "
    "option svg object embed canvas audio video dialog menu xmp noembed noframes".split()
)
UNWANTED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal newsletter subscribe subscription sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer comment comments respond reply replies share sharing social related "
    "recommended recommendations widget login signup search toolbar pagination pager complementary contentinfo dialog".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td dd dt".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_KEEPS_OPEN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Nesting that is told apart.
DEPTH = 128
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Classes that number a page; they are no part of a label.
_SERIAL = re.compile(r"[0-9]{3}")


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    unwanted: bool
    marked: bool
    children: list = field(default_factory=list)


def _marks(token: str) -> bool:
    """Whether a whole class, id or role says nothing but unwanted names: "cookie-notice" does, "has-sidebar" does not."""
    names = {w.lower() for w in _NAME.findall(token)}
    return bool(names) and names <= UNWANTED_NAMES


def _node(tag: str, attributes: str) -> Node:
    unwanted = tag in UNWANTED
    classes: list[str] = []
    marks: set[str] = set()
    hidden = False
    if attributes.strip(" \t\r\n/"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                marks.update(token.lower() for token in value.split() if _marks(token))
                if name == "class":
                    classes = sorted(value.split())
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
    if tag in ("html", "body", "article", "main"):
        marks.clear()
    label = ".".join([tag, *(c for c in classes if not _SERIAL.search(c))]) + "".join(f"#{m}" for m in sorted(marks)) + "!" * hidden
    return Node(tag, label, unwanted or hidden, bool(marks))


def parse(html: str) -> Node:
    """The tree of a page, however broken: unclosed and stray tags are repaired, raw text is kept as it is.

    Elements nested deeper than DEPTH are dissolved into their ancestor there; their text stays.
    """
    root = Node("", "", False, False)
    stack = [root]
    flat: Counter[str] = Counter()
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if not (text.startswith("<!") or text.startswith("<?")):
                stack[-1].children.append(unescape(text))
            continue
        tag = tag.lower()
        if m[1]:
            if flat[tag]:
                flat[tag] -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in BLOCK:
            _close(stack, ("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSED_BY:
            _close(stack, CLOSED_BY[tag], _KEEPS_OPEN[tag])
        node = _node(tag, m[3])
        if tag == "header" and any(above.tag == "article" for above in stack):
            # An article's own header holds its headline; it goes only where all pages have the same.
            node.unwanted = node.label.endswith("!")
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]|$", re.I).search(html, at)
            node.children.append(html[at : end.start()])
            closing = html.find(">", end.start())
            at = size if closing < 0 else closing + 1
            continue
        if len(stack) < DEPTH:
            stack.append(node)
        else:
            stack[-1].children.pop()
            flat[tag] += 1
    return root


def _close(stack: list[Node], tags, barriers) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            return
        if stack[depth].tag in barriers:
            return


def blocks(node: Node, skip=lambda child: False) -> list[str]:
    """The texts of the blocks below ``node`` in page order: one space for white space, none empty."""
    found: list[str] = []
    open_: list[str] = []

    def flush() -> None:
        text = " ".join("".join(open_).split())
        if text:
            found.append(text)
        open_.clear()

    work: list = [node]
    while work:
        item = work.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            open_.append(item)
        elif item is not node and (item.unwanted or skip(item)):
            if item.tag in BLOCK:
                flush()
        else:
            if item.tag == "br":
                open_.append(" ")
            if item.tag in BLOCK:
                flush()
                work.append(None)
            work.extend(reversed(item.children))
    flush()
    return found


@dataclass(slots=True)
class Shape:
    """A node of a skeleton, with its tree nodes if it is a page's; same-labelled blocks of text of a parent are one.

    ``path`` is set by alignment, equal for what is the same node of a template; ``text`` and ``own_text`` are digests of all text and of what
    stands in no child, ``size`` and ``own`` their lengths.
    """

    label: str
    path: int
    text: int = 0
    own_text: int = 0
    size: int = 0
    own: int = 0
    unwanted: bool = False
    marked: bool = False
    children: list = field(default_factory=list)
    nodes: list = field(default_factory=list)

    @property
    def tag(self) -> str:
        return self.label.split(".")[0].split("#")[0].rstrip("!")


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def path_of(parent: int, label: str) -> int:
    return digest(parent.to_bytes(8, "big", signed=True) + label.encode("utf-8", "surrogatepass"))


def skeleton(root: Node) -> Shape:
    """Block and marked elements of a page in order, each with digests and lengths of its text, without paths.

    Blocks of text and articles of one label below one parent are one node: their number is content, not template.
    """

    def shape(label: str, nodes: list[Node]) -> Shape:
        found: list[Node] = []
        texts = [text for node in nodes for text in _block_children(node, found)]
        parts: list[tuple[str, list[Node]]] = []
        merged: dict[str, list[Node]] = {}
        for node in found:
            if node.label in merged:
                merged[node.label].append(node)
                continue
            parts.append((node.label, [node]))
            if node.tag in TEXTUAL or node.tag in ("article", "main"):
                merged[node.label] = parts[-1][1]
        made = Shape(label, 0, nodes=nodes)
        made.own = made.size = sum(map(len, texts))
        own = "\n".join(texts).encode("utf-8", "surrogatepass")
        made.own_text = digest(own)
        made.unwanted = all(node.unwanted for node in nodes)
        made.marked = all(node.marked for node in nodes)
        made.children = [shape(name, of) for name, of in parts]
        made.size += sum(child.size for child in made.children)
        below = b"".join(child.text.to_bytes(8, "big", signed=True) for child in made.children)
        made.text = digest(own + b"\0" + below)
        return made

    return shape("", [root])


def _block_children(node: Node, found: list[Node]):
    """Texts that stand in ``node`` or in inline elements of it; block and marked elements met are added to ``found``."""
    work = list(reversed(node.children))
    while work:
        item = work.pop()
        if isinstance(item, str):
            if text := item.strip():
                yield text
        elif item.tag in BLOCK or (item.marked and item.tag not in RAW):
            found.append(item)
        elif item.tag not in RAW:
            work.extend(reversed(item.children))

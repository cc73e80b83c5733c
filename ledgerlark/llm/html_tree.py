"""A tolerant HTML reader: the element tree of a page and its text blocks, without external libraries."""

from __future__ import annotations

import re
from html import unescape

#: A comment, a tag (slash, name, attributes) or a declaration; quantifiers are possessive, so time is linear.
TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag that closes an open element of these, as far as the named border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}


class Node:
    __slots__ = ("tag", "parent", "style", "marks", "children", "hidden")

    def __init__(self, tag: str, parent: int, style: str, marks: frozenset, hidden: bool):
        self.tag, self.parent, self.style, self.marks, self.hidden, self.children = tag, parent, style, marks, hidden, []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def read(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order (0 is the root; parent is an index) and blocks (element, text).

    A block is the text between two borders of block-level elements, character references decoded, white space
    turned into one space and trimmed; blocks without text are left out. Contents of scripts and the like are no text.
    """
    nodes = [Node("", -1, "", frozenset(), False)]
    blocks: list[tuple[int, str]] = []
    stack, pieces, at, size = [0], [], 0, len(html)

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                holder = stack[-1]
                while nodes[holder].tag in INLINE:
                    holder = nodes[holder].parent
                blocks.append((holder, text))

    def close(wanted: set, border: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in wanted:
                del stack[k:]
                return
            if tag in border:
                return

    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            pieces.append(html[at:])
            break
        if m.start() > at:
            pieces.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                if any(nodes[i].tag == tag for i in stack[-8:]):
                    for k in range(len(stack) - 1, 0, -1):
                        t = nodes[stack[k]].tag
                        if t == tag:
                            del stack[k:]
                            break
                        if t not in INLINE:
                            break
            else:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        del stack[k:]
                        break
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag not in INLINE
        if block:
            flush()
            if tag in CLOSES:
                close(*CLOSES[tag])
            elif tag not in VOID and tag not in RAW:
                close({"p"}, {"article", "section", "div", "td", "th", "li", "body", "main", "aside", "nav", "header", "footer", "table", "button"})
        if tag in VOID:
            continue
        attrs = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}" if attrs else ""
        marks = frozenset(re.findall(r"[a-z]+", names.lower())) if names.strip() else frozenset()
        hidden = bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower())
        node = len(nodes)
        nodes.append(Node(tag, stack[-1], re.sub(r"\d+", "#", names.strip()), marks, hidden))
        nodes[stack[-1]].children.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = size if end is None else end.start()
            if end is not None:
                stop = html.find(">", at)
                at = size if stop < 0 else stop + 1
        elif not m[3].endswith("/") or block:
            stack.append(node)
    flush()
    return nodes, blocks

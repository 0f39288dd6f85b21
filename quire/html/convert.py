"""HTML to Markdown: headings with marks, fenced code, dashes for lists, pipe tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from quire.html.tree import BLOCKS, Node, parse

SKIPPED = {"script", "noscript", "style", "template", "head", "title", "svg"}
Rule = Callable[[Node, str], str | None]


def code_span(text: str) -> str:
    body = " ".join(text.split())
    if not body:
        return ""
    fence = "`" * (max((len(r) for r in re.findall("`+", body)), default=0) + 1)
    pad = " " if body[0] == "`" or body[-1] == "`" else ""
    return f"{fence}{pad}{body}{pad}{fence}"


def escaped(text: str) -> str:
    """Text of a page whose signs would be marks in Markdown: some anywhere, some only where the text begins."""
    text = re.sub(r"([\\*`\[\]_])", r"\\\1", text)
    return re.sub(r"^(?:(-|\+ |=+|#{1,6} |~~~|>)|(\d+)(?=\. ))", lambda m: "\\" + m[1] if m[1] else m[2] + "\\", text)


def _cell(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    if node.tag == "br":
        return "<br>"
    if node.tag in ("code", "kbd"):
        return code_span(node.text())
    inner = "".join(map(_cell, node.children))
    bare = inner.strip()
    if node.tag in ("strong", "b"):
        return f"**{bare}**" if bare else ""
    if node.tag in ("em", "i"):
        return f"*{bare}*" if bare else ""
    if node.tag == "a":
        return f"[{bare}]({node.attrs['href']})" if node.attrs.get("href") else bare
    if node.tag == "img":
        alt, src = node.attrs.get("alt", ""), node.attrs.get("src", "")
        return f"![{alt}]({src})" if src else alt
    return inner


def pipe_table(table: Node) -> str:
    """Rows that have cells, padded to the widest; the first is the head; a blank cell is one space."""
    rows = []
    for tr in table.elements():
        if tr.tag == "tr":
            cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("th", "td")]
            if cells:
                rows.append([re.sub(r"\s+", " ", "".join(map(_cell, c.children))).strip().replace("|", "\\|") for c in cells])
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join((c or " ") for c in row + [""] * (width - len(row))) + " |" for row in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def caption_drawings(root: Node) -> int:
    """A figure with a caption around each svg that has words: title, description, and texts that aren't mere numbers."""
    drawings = [n for n in root.elements() if n.tag == "svg"]
    for svg in drawings:
        words = [next((n.text().strip() for n in svg.elements() if n.tag == t), "") for t in ("title", "desc")]
        words += [t for n in svg.elements() if n.tag == "text" and (t := n.text().strip()) and not re.fullmatch(r"[\d\s.,%-]+", t)]
        words = [w for w in words if w]
        if words and svg.parent:
            figure = Node("figure", parent=svg.parent)
            svg.parent.children[svg.parent.children.index(svg)] = figure
            caption = Node("figcaption", parent=figure)
            caption.children.append(" | ".join(words))
            figure.children, svg.parent = [svg, caption], figure
    return len(drawings)


class Converter:
    """``rules``: by tag, functions of the element and its converted content; None falls through to the built-in way."""

    def __init__(self, rules: dict[str, Rule] | None = None):
        self.rules = rules or {}

    def convert(self, html: str | Node | None) -> str:
        root = parse(html) if not isinstance(html, Node) else html
        caption_drawings(root)
        text = self._children(root)
        return re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip(" ") if not line.endswith("  ") else line for line in text.split("\n"))).strip()

    def _children(self, node: Node) -> str:
        out = ""
        for c in node.children:
            piece = re.sub(r"\s+", " ", c) if isinstance(c, str) else self._node(c)
            if isinstance(c, str) and (out.endswith(("\n", " ")) or not out):
                piece = piece.lstrip(" ")
            if isinstance(c, str):
                piece = escaped(piece)
            if isinstance(c, Node) and (c.tag in BLOCKS or c.tag in ("li", "figcaption")):
                out = out.rstrip(" ")
            out += piece
        return out

    def _node(self, node: Node) -> str:
        tag = node.tag
        if tag in SKIPPED:
            return ""
        if tag in self.rules and (made := self.rules[tag](node, self._children(node))) is not None:
            return made
        if tag == "pre":
            return self._code(node)
        if tag in ("code", "kbd"):
            return code_span(node.text())
        if tag == "table":
            return f"\n\n{pipe_table(node)}\n\n"
        if tag in ("ul", "ol"):
            return self._list(node)
        inner = self._children(node)
        bare = inner.strip()
        if tag in ("strong", "b", "em", "i", "del", "s", "strike"):
            mark = {"strong": "**", "b": "**", "em": "*", "i": "*"}.get(tag, "~~")
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            return f"{lead}{mark}{bare}{mark}{tail}" if bare else ""
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n* * *\n\n"
        if tag == "img":
            alt, src = node.attrs.get("alt", ""), node.attrs.get("src", "")
            return f"![{alt}]({src})" if src else ""
        if tag == "a":
            href = node.attrs.get("href")
            return f"[{bare}]({href})" if href and bare else inner
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {' '.join(bare.split())}\n\n" if bare else ""
        if tag == "blockquote":
            lines = re.sub(r"\n{3,}", "\n\n", bare).split("\n")
            return "\n\n" + "\n".join(("> " + x).rstrip() for x in lines) + "\n\n"
        if tag == "figcaption":
            return f"\n\n{bare}\n\n"
        return f"\n\n{bare}\n\n" if tag in BLOCKS else inner

    def _code(self, node: Node) -> str:
        code = next((n for n in node.elements() if n.tag == "code"), node)
        names = [c for n in (code, node) for c in n.attrs.get("class", "").split()]
        language = next((m[1] for c in names if (m := re.match(r"lang(?:uage)?-(\S+)", c))), "")
        body = code.text()
        body = body[:-1] if body.endswith("\n") else body
        fence = "`" * max(3, max((len(r) for r in re.findall(r"(?m)^`+", body)), default=0) + 1)
        return f"\n\n{fence}{language}\n{body}\n{fence}\n\n"

    def _list(self, node: Node) -> str:
        items, number = [], int(node.attrs.get("start") or 1)
        for c in node.children:
            if isinstance(c, Node) and c.tag == "li":
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                body = re.sub(r"\n{3,}", "\n\n", self._children(c).strip())
                body = re.sub(r"\n\n(?=\s*(?:- |\d+\. ))", "\n", body)
                items.append(mark + body.replace("\n", "\n" + " " * len(mark)))
        return "\n\n" + "\n".join(items) + "\n\n"

"""Selectors: tags, ids, classes, attributes (=, ^=, *=, $=, ~=), descendants, children and lists."""

from __future__ import annotations

import re

from quire.html.tree import Node

_SIMPLE = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^*$]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]""")


def compile_selector(selector: str) -> list[list[tuple[str, list[tuple[str, str, str]]]]]:
    """Alternatives of steps (combinator, tests); ValueError for what isn't in the grammar."""
    out = []
    for alternative in _split(selector, ","):
        steps, at, join, text = [], 0, " ", alternative.strip()
        if not text:
            raise ValueError(selector)
        while at < len(text):
            gap = re.compile(r"\s*(>)?\s*").match(text, at)
            if gap.end() > at:
                join, at = (gap[1] or " "), gap.end()
            tests = []
            while m := _SIMPLE.match(text, at):
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower(), ""))
                elif m["id"]:
                    tests.append(("=", "id", m["id"]))
                elif m["cls"]:
                    tests.append(("~=", "class", m["cls"]))
                else:
                    tests.append((m["op"] or "has", m["attr"].lower(), m["a"] or m["b"] or m["c"] or ""))
                at = m.end()
            if not tests:
                raise ValueError(selector)
            steps.append((join, tests))
            join = " "
        out.append(steps)
    return out


def _split(text: str, mark: str) -> list[str]:
    parts, depth, quote = [""], 0, ""
    for c in text:
        quote = "" if c == quote else c if not quote and c in "\"'" else quote
        depth += (c == "[") - (c == "]") if not quote else 0
        if c == mark and not depth and not quote:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _fits(node: Node, tests: list[tuple[str, str, str]]) -> bool:
    for op, name, value in tests:
        if op == "tag":
            if name not in ("*", node.tag):
                return False
            continue
        held = node.attrs.get(name)
        if held is None or not (op == "has" or op == "=" and held == value or op == "^=" and value and held.startswith(value) or op == "*=" and value and value in held or op == "$=" and value and held.endswith(value) or op == "~=" and value in held.split()):
            return False
    return True


def matches(node: Node, steps: list[tuple[str, list]]) -> bool:
    if not _fits(node, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    up = node.parent
    while up is not None and up.tag != "#root":
        if matches(up, steps[:-1]):
            return True
        if steps[-1][0] == ">":
            return False
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    compiled = compile_selector(selector)
    return [n for n in root.elements() if any(matches(n, steps) for steps in compiled)]


def first(root: Node, selector: str) -> Node | None:
    compiled = compile_selector(selector)
    return next((n for n in root.elements() if any(matches(n, steps) for steps in compiled)), None)

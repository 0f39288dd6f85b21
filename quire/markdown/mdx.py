"""MDX to Markdown: imports dropped, static values folded, known components rewritten."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from quire.markdown.fences import segments

UNWRAPPED = {"Steps", "Tabs", "AccordionGroup", "CardGroup"}
#: Heading marks of components with a title, labels of callouts.
HEADED = {"Step": "###", "Tab": "####", "Accordion": "####"}
CALLOUTS = {"Info": "Note", "Note": "Note", "Tip": "Tip", "Warning": "Warning"}
_TAG = re.compile(r"<(/?)([A-Z][\w.]*)((?:\s+[\w:-]+(?:=(?:\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{[^{}]*\})*\}))?)*)\s*(/?)>")


class Dynamic(ValueError):
    """A value that only running the page would give."""


def static(expression: str) -> str:
    """The text of a literal; comments, null and booleans have none."""
    e = re.sub(r"(?s)/\*.*?\*/", "", expression).strip()
    if e in ("", "null", "true", "false", "undefined") and e != "undefined":
        return ""
    if m := re.fullmatch(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'", e):
        return re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1] if m[1] is not None else m[2])
    if re.fullmatch(r"`[^`$\\]*`", e):
        return e[1:-1]
    if re.fullmatch(r"[+-]?\s*\d+(\.\d+)?", e):
        return e.replace(" ", "").lstrip("+")
    raise Dynamic(f"dynamic expression: {e[:40]}")


def attributes(text: str) -> dict[str, str]:
    out = {}
    for m in re.finditer(r"([\w:-]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|\{((?:[^{}]|\{[^{}]*\})*)\}))?", text):
        out[m[1]] = m[2] if m[2] is not None else m[3] if m[3] is not None else static(m[4]) if m[4] is not None else ""
    return out


def _dedent(text: str) -> str:
    lines = text.split("\n")
    indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(x[indent:] for x in lines)


def _component(name: str, attrs: dict[str, str], inner: str, page: str | None) -> str:
    title = attrs.get("title", "")
    if name in UNWRAPPED:
        return inner
    if name == "Card":
        if not title and not inner.strip():
            raise Dynamic("a card without title or body")
        href = urljoin(page or "", attrs["href"]) if attrs.get("href") else ""
        label = re.sub(r"([\\\[\]])", r"\\\1", title)
        head = f"[{label or href}]({re.sub(r'[\s()]', lambda m: '%%%02X' % ord(m[0]), href)})" if href else label
        return "\n" + (f"**{head}**\n\n" if head else "") + inner + "\n"
    if name in HEADED:
        return f"\n{HEADED[name]} {title}\n\n{inner}\n" if title else f"\n{inner}\n"
    if name in CALLOUTS:
        body = inner.strip("\n").split("\n")
        return f"\n> **{CALLOUTS[name]}:**\n>\n" + "\n".join(("> " + x.strip()).rstrip() for x in body) + "\n"
    if not inner.strip():
        raise Dynamic(f"an empty component: {name}")
    return inner


def _prose(text: str, page: str | None, theme: str) -> str:
    stack: list[tuple[str, dict[str, str], list[str]]] = [("", {}, [""])]
    at = 0
    for m in _TAG.finditer(text):
        stack[-1][2].append(text[at : m.start()])
        at = m.end()
        if m[1]:
            if stack[-1][0] != m[2]:
                raise Dynamic(f"closing tag without its opening: {m[2]}")
            name, attrs, parts = stack.pop()
            stack[-1][2].append(_component(name, attrs, _dedent("".join(parts).strip("\n")), page))
        elif m[4]:
            stack[-1][2].append(_component(m[2], attributes(m[3]), "", page))
        else:
            stack.append((m[2], attributes(m[3]), [""]))
    if len(stack) > 1:
        raise Dynamic(f"no closing tag: {stack[-1][0]}")
    out = "".join(stack[0][2]) + text[at:]

    def picture(m: re.Match) -> str:
        classes = set(re.findall(r"[^\s\"']+", (re.search(r"class(?:Name)?=[\"']([^\"']*)", m[0]) or ["", ""])[1]))
        hidden = "dark:hidden" in classes if theme == "dark" else "hidden" in classes and any(re.fullmatch("dark:(block|inline|flex)", c) for c in classes)
        return "" if hidden else m[0]

    out = re.sub(r"<img\b[^>]*>", picture, out)
    return re.sub(r"(?<!\\)\{((?:[^{}]|\{[^{}]*\})*)\}", lambda m: static(m[1]), out)


def strip_mdx(text: str, page: str | None = None, theme: str = "light") -> str:
    """Markdown of an MDX page; Dynamic where it can't be told without running it. Code stays as it is."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    parts = []
    for kind, part in segments(text):
        if kind == "code":
            held.append(_dedent(part))
            indent = part[: len(part) - len(part.lstrip(" \t"))]
            parts.append(f"{indent}\x00{len(held) - 1}\x00")
        else:
            part = re.sub(r"(?m)^(?:import|export)\s[^\n]*(?:\n(?![ \t]*\n|[<#>`\x00-])[^\n]*)*\n?", "", part)
            parts.append(re.sub(r"(?<!`)(`+)(?!`).+?(?<!`)\1(?!`)", keep, part))
    out = _prose("\n".join(parts), page, theme)
    out = re.sub("(?m)^([ \t]*)\x00(\\d+)\x00[ \t]*$", lambda m: "\n".join(m[1] + x if x else x for x in held[int(m[2])].split("\n")), out)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], out)

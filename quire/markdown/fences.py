"""Five ways of telling code from prose; each has users that need just it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_FENCE = re.compile(r"^((?:[ \t]*>)*[ \t]*)(`{3,}|~{3,})(.*)$")


def segments(text: str) -> list[tuple[str, str]]:
    """("prose" or "code", lines): fences may be quoted or indented; one ends at a run of its own sign, as long at least,
    with nothing after it; an open one runs to the end. Joining the parts by line feeds gives the text back."""
    out: list[tuple[str, list[str]]] = []
    mark = ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        opens = bool(m) and not mark and not (m[2][0] == "`" and "`" in m[3])
        closes = bool(m) and bool(mark) and m[2][0] == mark[0] and len(m[2]) >= len(mark) and not m[3].strip()
        kind = "code" if mark or opens else "prose"
        if opens:
            mark = m[2]
            out.append((kind, [line]))
        elif out and out[-1][0] == kind:
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
        if closes:
            mark = ""
            out.append(("prose", []))
    return [(k, "\n".join(v)) for k, v in out if v]


def quoted_states(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """(line, in code): one quote mark allowed; anything may follow the closing run."""
    mark = ""
    for line in lines:
        m = re.match(r"^\s*>?\s*(`{3,}|~{3,})", line)
        inside = bool(mark) or bool(m)
        if m and not mark:
            mark = m[1]
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark):
            mark = ""
        yield line, inside


def column_states(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """(line, in code): only fences at the start of a line."""
    mark = ""
    for line in lines:
        m = re.match(r"^(`{3,}|~{3,})", line)
        inside = bool(mark) or bool(m)
        if m and not mark:
            mark = m[1]
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark):
            mark = ""
        yield line, inside


def toggled_states(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """(line, in code): each line that begins with three backticks or tildes turns it over."""
    inside = False
    for line in lines:
        turn = line.strip().startswith(("```", "~~~"))
        yield line, inside or turn
        inside ^= turn


def map_prose(text: str, change: Callable[[str], str], inline: bool = False) -> str:
    """``change`` on all but fenced and indented code; with ``inline`` code spans count as code too."""
    out = []
    for kind, part in segments(text):
        if kind == "code":
            out.append(part)
            continue
        blocks: list[tuple[bool, list[str]]] = []
        blank, listed = True, False
        for line in part.split("\n"):
            empty = not line.strip()
            listed = bool(re.match(r"^\s{0,3}([-*+]|\d+[.)])\s", line)) or listed and (empty or line.startswith(" "))
            code = not listed and bool(re.match(r"^( {4}|\t)", line)) and (blank or bool(blocks) and blocks[-1][0]) and not empty
            if blocks and (blocks[-1][0] == code or empty):
                blocks[-1][1].append(line)
            else:
                blocks.append((code, [line]))
            blank = empty
        out.append("\n".join("\n".join(v) if code else _outside_spans("\n".join(v), change) if inline else change("\n".join(v)) for code, v in blocks))
    return "\n".join(out)


def _outside_spans(text: str, change: Callable[[str], str]) -> str:
    """``change`` between code spans; a run of backticks ends at the next run of the same length."""
    out, at, plain = [], 0, 0
    while m := re.compile("`+").search(text, at):
        end = re.compile(rf"(?<!`){m[0]}(?!`)").search(text, m.end())
        if not end:
            at = m.end()
            continue
        out += [change(text[plain : m.start()]), text[m.start() : end.end()]]
        at = plain = end.end()
    return "".join([*out, change(text[plain:])])

"""Markdown to Markdown, and to segments, on plain strings."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from quire.markdown.fences import column_states, map_prose, quoted_states, segments, toggled_states

_IMAGE_LINE = re.compile(r"^!\[([^\]]*)\]\(([^)]*)\)\s*(\{[^}]*\})?$")


def resolve(target: str, page: str) -> str:
    return urljoin(page, target) if target.startswith(("/", "./", "../")) else target


def absolute_urls(text: str, page: str) -> str:
    """Targets of links, images and HTML attributes in prose against the page's URL."""

    def change(part: str) -> str:
        part = re.sub(r"(!?\[[^\]]*\]\()([^)\s]+)", lambda m: m[1] + resolve(m[2], page), part)
        part = re.sub(r"(?i)(<(?:img|a)\b[^>]*?\s(?:src|href)=[\"'])([^\"']+)", lambda m: m[1] + resolve(m[2], page), part)
        return re.sub(r"(?i)(<(?:source|img)\b[^>]*?\ssrcset=[\"'])([^\"']+)", lambda m: m[1] + ", ".join(" ".join([resolve(x.split()[0], page), *x.split()[1:]]) for x in m[2].split(",") if x.strip()), part)

    return map_prose(text, change, inline=True)


def split_glued_images(text: str) -> str:
    """A blank line between an image at the start of a line and text that follows it without one."""
    out = []
    for line, code in column_states(text.split("\n")):
        m = None if code else re.match(r"^(!\[[^\]]*\]\([^)]+\)(?:\s*\{[^}]*\})?|<img\b[^>]*>)(?=\S)(.+)$", line)
        out += [m[1], "", m[2]] if m else [line]
    return "\n".join(out)


def demote_headings(text: str) -> str:
    return map_prose(text, lambda p: re.sub(r"(?m)^(#{1,5})(?=[ \t])", r"#\1", p))


def break_underscores(text: str) -> str:
    """Escaped underscores in prose may break in print."""
    return map_prose(text, lambda p: p.replace("\\_", "\\_\\allowbreak{}"), inline=True)


def clean_fence_headers(text: str) -> str:
    """After a language, an opening fence keeps nothing but one {...}."""

    def header(part: str) -> str:
        first, feed, rest = part.partition("\n")
        m = re.match(r"([ \t]*(?:>[ \t]*)*(?:`{3,}|~{3,})[A-Za-z0-9_-]+)(.*)$", first)
        more = m[2].strip() if m else ""
        if more:
            first = m[1] + (f" {more}" if re.fullmatch(r"\{[^}]*\}", more) else "")
        return first + feed + rest

    return "\n".join(header(p) if k == "code" else p for k, p in segments(text))


def plain_long_code(text: str, most: int = 100) -> str:
    """Fences without a language where a line is longer than ``most``."""
    out = []
    for kind, part in segments(text):
        lines = part.split("\n")
        if kind == "code" and any(len(x) > most for x in lines[1:]):
            lines[0] = re.sub(r"(`{3,}|~{3,}).*$", r"\1", lines[0])
        out.append("\n".join(lines))
    return "\n".join(out)


def gap_before_tables(text: str) -> str:
    """A blank line between a paragraph and the table under it."""
    return map_prose(text, lambda p: re.sub(r"(?m)^([^|\n].*)\n(\|.*\|.*\n\|[-: ]+\|)", r"\1\n\n\2", p))


def fix_quotes(text: str) -> str:
    """In block quotes: empty items lose their mark, a bare quote line before lists, headings in bold."""

    def lists(part: str) -> str:
        part = re.sub(r"(?m)^(>[^\S\n]*)[-*][^\S\n]*$", r"\1", part)
        return re.sub(r"(?m)^(>(?![^\S\n]*[-*]\s).+\S)\n(>[^\S\n]*[-*][^\S\n]+\S)", r"\1\n>\n\2", part)

    lines = quoted_states(map_prose(text, lists).split("\n"))
    return "\n".join(x if code else re.sub(r"^(>\s*)#{1,6}\s+(.+?)\s*$", r"\1**\2**", x) for x, code in lines)


def drop_index_callout(text: str) -> str:
    """A first block quote that says Documentation Index goes."""
    lines = text.split("\n")
    at = next((k for k, x in enumerate(lines) if x.strip()), 0)
    end = at
    while end < len(lines) and lines[end].startswith(">"):
        end += 1
    return "\n".join(lines[end:]).lstrip("\n") if end > at and "Documentation Index" in "\n".join(lines[at:end]) else text


def table_row(line: str) -> list[str] | None:
    """Cells of a row between outer bars, or none; bars after a backslash or in code spans don't separate."""
    bare = line.strip()
    if len(bare) < 2 or bare[0] != "|" or bare[-1] != "|":
        return None
    cells, open_run = [""], 0
    for piece in re.findall(r"`+|\\\||\||[^`|\\]+|\\", bare[1:-1]):
        if piece == "|" and not open_run:
            cells.append("")
            continue
        cells[-1] += piece
        if piece[0] == "`":
            open_run = len(piece) if not open_run else 0 if open_run == len(piece) else open_run
    return [c.strip() for c in cells]


def is_rule(cells: list[str] | None) -> bool:
    return bool(cells) and all(re.fullmatch(r":?-{3,}:?", c) for c in cells)


#: Heads of tables by kind, and the rules that give their columns fitting widths in print.
TABLES = {"field": ("field", "required", "description"), "reference": ("key", "type / values", "details"), "metric": ("metric", "type", "fields", "description"), "sandbox": ("intent", "flags", "effect")}
TABLE_HEADS = {
    "reference": "| Key | Type / Values | Details |\n|:------------------------------------|:----------------------------|:----------------------------------------------------|",
    "metric": "| Metric | Type | Fields | Description |\n|:------------------------------------------|:--------------|:------------------------------|:------------------------------------------------|",
    "sandbox": "| Intent | Flags | Effect |\n|:--------------------------------|:----------------------------------------------|:----------------------------------------------------|",
}


def _table_at(lines: list[str], at: int) -> tuple[str | None, list[list[str]]]:
    """Kind of the known table whose head stands at a line, and its body rows."""
    head = table_row(lines[at])
    kind = next((k for k, names in TABLES.items() if head and names == tuple(" ".join(c.split()).lower() for c in head)), None)
    if not kind or at + 1 >= len(lines) or not is_rule(table_row(lines[at + 1])):
        return None, []
    rows = []
    for line in lines[at + 2 :]:
        cells = table_row(line)
        if not cells or len(cells) != len(TABLES[kind]):
            break
        rows.append(cells)
    return kind, rows


def format_tables(text: str) -> str:
    """Known reference tables with fitting column widths and breakable code; field tables as paragraphs."""

    def cell(value: str) -> str:
        return breakable_line(re.sub(r"(\]\([^)]+\))(?=[A-Za-z0-9])", r"\1 ", value.replace("\\|", "|").strip()))

    def change(part: str) -> str:
        lines, out, at = part.split("\n"), [], 0
        while at < len(lines):
            kind, rows = _table_at(lines, at)
            if kind == "field":
                for name, needed, said in rows:
                    out += ["", r"\Needspace{4\baselineskip}", "", rf"**Field:** {name} \hfill{{}} **Required:** {needed}", "", r"\nopagebreak[4]", "", said]
            elif kind:
                out += [TABLE_HEADS[kind], *("| " + " | ".join(map(cell, row)) + " |" for row in rows)]
            else:
                out.append(lines[at])
            at += len(rows) + 2 if kind else 1
        return "\n".join(out)

    return map_prose(text, change)


def reference_cards(text: str) -> str:
    """Blocks of lines Key, Type / Values and Details as three labelled paragraphs; keys that a reference table, a paragraph
    or a block before has go."""

    def name(value: str) -> str:
        bare = value.replace("\\|", "|").strip()
        m = re.fullmatch(r"(?s)`([^`]*)`", bare)
        return m[1].strip() if m else bare

    def change(part: str) -> str:
        lines, out, seen, at = part.split("\n"), [], set(), 0
        while at < len(lines):
            kind, rows = _table_at(lines, at)
            if kind == "reference":
                seen |= {name(r[0]) for r in rows}
                out += lines[at : at + 2 + len(rows)]
                at += 2 + len(rows)
                continue
            full = [k for k in range(at, len(lines)) if lines[k].strip()][:6] if lines[at].strip() == "Key" else []
            labels = [lines[k].strip() for k in full]
            if len(full) < 6 or (labels[2], labels[4]) != ("Type / Values", "Details"):
                out.append(lines[at])
                if m := re.match(r"^\*\*Key:\*\*\s+(.+)$", lines[at]):
                    seen.add(name(m[1]))
                at += 1
                continue
            end = full[5]
            while end < len(lines) and lines[end].strip():
                end += 1
            if name(labels[1]) not in seen:
                details = " ".join(x.strip() for x in lines[full[5] : end])
                out += [f"**Key:** {labels[1]}", "", f"**Type / Values:** {name(labels[3])}", "", f"**Details:** {details}", ""]
                seen.add(name(labels[1]))
            at = end
        return "\n".join(out)

    return map_prose(text, change)


#: Characters that print escapes, and those after which it may break a line.
_ESCAPES = {"\\": r"\textbackslash{}", "$": r"\$", "%": r"\%", "&": r"\&", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
_BREAKS = set("/\\._-:|,={}[]")


def _printed(code: str) -> str:
    out = []
    for before, c in zip(" " + code, code, strict=False):
        hump = "A" <= c <= "Z" and re.match("[a-z0-9]", before)
        out += [r"\allowbreak{}" if hump else "", _ESCAPES.get(c, c), r"\allowbreak{}" if c in _BREAKS else ""]
    return rf"\texttt{{{''.join(out)}}}"


def breakable_line(line: str, least: int = 12) -> str:
    """Long paths and names in a line's code spans as print code that may break after separators and at humps."""
    runs, out, at, k = list(re.finditer("`+", line)), [], 0, 0
    while k < len(runs):
        close = next((j for j in range(k + 1, len(runs)) if len(runs[j][0]) == len(runs[k][0])), None)
        if close is None:  # an open span: the rest of the line stays
            break
        code = line[runs[k].end() : runs[close].start()]
        path = re.search(r"[\\/._:\[\]-]", code)
        name = not re.search(r"[\\/._:\s-]", code) and re.search("[a-z0-9][A-Z]", code)
        wide = "|" in code or len(code) >= least and (path or name)
        out += [line[at : runs[k].start()], _printed(code) if wide else line[runs[k].start() : runs[close].end()]]
        at, k = runs[close].end(), close + 1
    return "".join(out) + line[at:]


def breakable_code(text: str) -> str:
    """``breakable_line`` of all lines of prose but headings."""
    return map_prose(text, lambda p: "\n".join(x if re.match(r"\s*#", x) else breakable_line(x) for x in p.split("\n")))


def callout_labels(text: str) -> str:
    """A callout's label stays on the page of what follows."""
    return map_prose(text, lambda p: re.sub(r"(?m)^(> \*\*(?:Note|Tip|Warning):\*\*)\n>\n", r"\1\n>\n> \\nopagebreak[4]\n>\n", p))


def image_references(text: str) -> list[dict]:
    """Images in prose, Markdown and HTML: type, start, end, alt, url, title, in order; brackets may nest."""
    out, base = [], 0
    for kind, part in segments(text):
        if kind == "prose":
            at = 0
            while (at := part.find("![", at)) >= 0:
                depth, end = 1, at + 2
                while end < len(part) and depth:
                    depth += (part[end] == "[") - (part[end] == "]") if part[end - 1] != "\\" else 0
                    end += 1
                m = re.compile(r"\(\s*(?:<([^>\n]*)>|((?:\\.|[^\s()\\]|\([^\s()]*\))*))(?:\s+(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\)))?\s*\)").match(part, end) if not depth else None
                if m and (at == 0 or part[at - 1] != "\\"):
                    out.append({"type": "markdown", "start": base + at, "end": base + m.end(), "alt": part[at + 2 : end - 1], "url": m[1] if m[1] is not None else m[2], "title": m[3] or m[4] or m[5]})
                    at = m.end()
                else:
                    at += 2
            for m in re.finditer(r"(?i)<img\b[^>]*>", part):
                attr = {k.lower(): v for k, v in re.findall(r"([\w-]+)\s*=\s*[\"']([^\"']*)[\"']", m[0])}
                if attr.get("src"):
                    out.append({"type": "html", "start": base + m.start(), "end": base + m.end(), "alt": attr.get("alt", ""), "url": attr["src"], "title": attr.get("title")})
        base += len(part) + 1
    return sorted(out, key=lambda x: x["start"])


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Replacements of spans that don't overlap, from the end."""
    for start, end, new in sorted(edits, key=lambda e: (-e[0], -e[1])):
        text = text[:start] + new + text[end:]
    return text


def rewrite_images(text: str, resolved: dict[str, str]) -> tuple[str, list[str]]:
    """Remote images with the addresses given; those without one are errors."""
    edits, missing = [], []
    for ref in image_references(text):
        if re.match(r"(?i)https?://", ref["url"]):
            if ref["url"] in resolved:
                edits.append((ref["start"], ref["end"], text[ref["start"] : ref["end"]].replace(ref["url"], resolved[ref["url"]])))
            else:
                missing.append(ref["url"])
    return apply_edits(text, edits), missing


def size_images(text: str) -> str:
    """Images alone on a line: icons {width=40px}, others {width=100%}; an icon joins a third-level heading after it."""

    def change(part: str) -> str:
        def one(m: re.Match) -> str:
            icon = re.search(r"(^|[-_/])icon([-.]|$)", m[2].rsplit("/", 1)[-1].split("?")[0])
            return f"![{m[1]}]({m[2]}){{width={'40px' if icon else '100%'}}}"

        part = re.sub(r"(?m)^!\[([^\]]*)\]\(([^)\s]+)\)[ \t]*$", one, part)
        return re.sub(r"(?m)^(!\[[^\]]*\]\([^)]*\)\{width=40px\})\n+### (.*)$", r"### \1 \2", part)

    return map_prose(text, change)


def link_spacing(text: str) -> str:
    """A space between a link and a word right after it, none inside its brackets."""
    return re.sub(r"(\]\([^)\s]*\))(?=[A-Za-z0-9])", r"\1 ", re.sub(r"\[\s+([^\]]*?)\s+\]\(", r"[\1](", text))


def article(text: str, title: str | None = None, most_code: int = 100) -> str:
    """A source article ready for a book: index callout and repeated title off, tables, quotes, images and code cleaned,
    headings one level down. The order of the steps matters."""
    text = drop_index_callout(text)
    if title:
        m = re.match(r"^\s*#{1,6}[ \t]+([^\n]*)\n*", text)
        if m and re.sub(r"\s+", "", m[1]).lower() == re.sub(r"\s+", "", title).lower():
            text = text[m.end() :]
    text = plain_long_code(clean_fence_headers(text), most_code)
    for step in (gap_before_tables, break_underscores, reference_cards, format_tables, fix_quotes, size_images, breakable_code, callout_labels):
        text = step(text)
    return demote_headings(text)


def translation_plan(text: str, bilingual: bool = False) -> dict:
    """output lines with places for segments, segments, and captions of images to translate."""
    lines, parts, captions, held = [], [], [], []

    def flush() -> None:
        body = "\n".join(held).strip()
        held.clear()
        if body:
            lines.append(f"__MD_SEGMENT_md-{len(parts)}__")
            parts.append({"id": f"md-{len(parts)}", "text": body})

    source = text.split("\n")
    front = 0
    if source[0].strip() == "---":
        front = next((k for k in range(1, len(source)) if source[k].strip() == "---"), len(source) - 1) + 1
    lines += source[:front]
    for line, code in toggled_states(source[front:]):
        bare = line.strip()
        image = _IMAGE_LINE.match(bare)
        if code or not bare or image:
            flush()
            if image and not code and bilingual and image[1].strip():
                captions.append({"id": f"img-{len(captions)}", "alt": image[1].strip(), "line": len(lines)})
            lines.append(line)
            continue
        if held and re.match(r"^(#{1,6}\s|[*+-]\s|\d+\.\s)", bare):
            flush()
        held.append(line)
    flush()
    return {"lines": lines, "segments": parts, "captions": captions}


def render_translation(plan: dict, translations: dict[str, str], captions: dict[str, str] | None = None, bilingual: bool = False) -> str:
    """A plan's lines with translations, or the originals where there is none; with both texts if bilingual."""
    original = {s["id"]: s["text"] for s in plan["segments"]}
    by_line = {c["line"]: c for c in plan["captions"]}
    out = []
    for k, line in enumerate(plan["lines"]):
        if m := re.match(r"^__MD_SEGMENT_(md-\d+)__$", line):
            new = translations.get(m[1]) or original[m[1]]
            out.append(f"{original[m[1]]}\n\n{new}" if bilingual else new)
            continue
        c = by_line.get(k)
        said = ((captions or {}).get(c["id"]) or "").strip() if c else ""
        out.append(f"{line}\n_{said}_" if bilingual and said and said != c["alt"] else line)
    return "\n".join(out)


def protected_ranges(text: str) -> list[tuple[int, int]]:
    """Code spans, HTML, images, link targets and bare URLs, merged."""
    found = [m.span() for p in (r"(?<!`)(`+)(?!`).+?(?<!`)\1(?!`)", r"<[^>\n]+>", r"!\[[^\]]*\]\([^)]*\)", r"(?<=\])\([^)]*\)", r"https?://[^\s)>\]]+") for m in re.finditer(p, text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def annotation_segments(text: str) -> list[dict]:
    """Paragraphs of prose: id, text, start, end, indent, protected ranges; no front matter, code, headings or tables."""
    out, at = [], 0
    body = re.match(r"(?s)^---\n.*?\n---\n", text)
    skip = body.end() if body else 0
    for kind, part in segments(text):
        if kind == "prose":
            for m in re.finditer(r"(?:^|(?<=\n))[^\S\n]*\S[^\n]*(?:\n[^\S\n]*\S[^\n]*)*", part):
                start = at + m.start()
                if start < skip:
                    continue
                for item in re.finditer(r"(?m)^([ \t]*(?:[-*+]|\d+\.)[ \t]+)?(\S[^\n]*(?:\n(?![ \t]*(?:[-*+]|\d+\.)[ \t])[^\n]+)*)", m[0]):
                    value = item[2]
                    rows = value.split("\n")
                    if re.match(r"^(#{1,6}\s|>|<|!\[)", value) or len(rows) > 1 and all("|" in r for r in rows):
                        continue
                    a = start + item.start(2)
                    out.append({"id": f"segment-{len(out) + 1:04d}", "text": value, "start": a, "end": a + len(value), "indent": len(item[1] or ""), "protected": protected_ranges(value)})
        at += len(part) + 1
    return out


def locate(text: str, quote: str, n: int) -> int:
    """Place of the n-th of the occurrences that don't overlap, or -1."""
    at = -len(quote)
    for _ in range(n):
        at = text.find(quote, at + len(quote))
        if at < 0:
            return -1
    return at


def annotation_violations(segment: dict, annotations: list[dict], most: int) -> list[str]:
    """Rules that a segment's annotations break: density, prompts, place, protection, overlap."""
    out = ["density"] * (len(annotations) > most) + ["prompts"] * (sum(bool(a.get("prompt")) for a in annotations) > 1)
    spans: list[tuple[int, int]] = []
    for a in annotations:
        start = locate(segment["text"], a["quote"], a["occurrence"])
        end = start + len(a["quote"])
        if start < 0:
            out.append("quote_missing")
            continue
        out += ["protected"] * any(x < end and y > start for x, y in segment["protected"])
        out += ["overlap"] * any(x < end and y > start for x, y in spans)
        spans.append((start, end))
    return out


#: Labels of annotations by type and of readers by level; types that a review asks about first.
TYPE_LABELS = {
    "word": "生词",
    "phrasal-verb": "短语动词",
    "idiom": "惯用语",
    "collocation": "搭配",
    "native-expression": "地道表达",
    "technical-term": "技术术语",
    "slang": "俚语",
    "grammar-pattern": "语法结构",
    "discourse-logic": "篇章逻辑",
    "register-usage": "语域用法",
    "writing-pattern": "写作句型",
    "concept": "关键概念",
}
HIGHER_TYPES = ("grammar-pattern", "discourse-logic", "register-usage", "writing-pattern", "concept")
LEVEL_LABELS = {"junior-high": "初中", "high-school": "高中", "university": "大学"}
ACCENT_LABELS = {"uk": "英式", "us": "美式"}


def plain(value: str) -> str:
    """One line, Markdown's marks escaped."""
    return re.sub(r"([\\`*_\[\]])", r"\\\1", " ".join(value.split()))


def _annotation_block(indent: str, notes: list[dict], level: str) -> str:
    lines = ["::: english-annotation", f"**英语批注 · {LEVEL_LABELS[level]}**", ""]
    for a in notes:
        said = a.get("ipa") or {}
        ipa = "".join(f" · {label} IPA {plain(said[accent])}" for accent, label in ACCENT_LABELS.items() if said.get(accent))
        lines += [f"- **{plain(a['quote'])}**（{TYPE_LABELS[a['type']]}{ipa}）：{plain(a['explanation'])}", "", f"  **例句：** {plain(a['example'])}"]
    return "\n".join(indent + x for x in [*lines, ":::"])


def render_annotations(text: str, parts: list[dict], found: dict[str, list[dict]], level: str = "high-school", top: int = 3) -> str:
    """Quotes marked, a block of explanations after their paragraph, and a review of up to ``top`` prompts: types of higher
    order first, else in order. Quotes that can't be found are not marked."""
    edits, asked = [], []
    for p in parts:
        notes = found.get(p["id"]) or []
        if not notes:
            continue
        after = text[p["end"] : p["end"] + 2]
        gap = "" if after == "\n\n" else "\n" if after[:1] == "\n" or not after else "\n\n"
        edits.append((p["end"], p["end"], f"\n\n{_annotation_block(' ' * p['indent'], notes, level)}{gap}"))
        for a in notes:
            at = locate(p["text"], a["quote"], a["occurrence"])
            if at >= 0:
                edits.append((p["start"] + at, p["start"] + at + len(a["quote"]), f'<span class="english-annotation-source">{a["quote"]}</span>'))
        asked += [a for a in notes if a.get("prompt")]
    out = apply_edits(text, edits)
    picked = sorted(asked, key=lambda a: a["type"] not in HIGHER_TYPES)[:top]
    if not picked:
        return out
    review = ["::: english-learning-review", "**学习回顾 · 先不看批注**", "", "用自己的话回答；答不出时，再回看上方对应批注。", ""]
    review += [f"{k}. **{plain(a['quote'])}**：{plain(a['prompt'])}" for k, a in enumerate(picked, 1)] + [":::"]
    gap = "" if out.endswith("\n\n") else "\n" if out.endswith("\n") else "\n\n"
    return out + gap + "\n".join(review) + "\n"

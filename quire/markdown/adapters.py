"""Site adapters: clean-ups that hold for one site, chosen by name or by URL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.html.select import select
from quire.html.tree import Node


@dataclass
class Adapter:
    """``hosts``: where it applies; ``content``: change of the content tree; ``text``: changes of its Markdown, in order;
    ``pages``: (pattern, change): further ones for pages whose URL a regular expression finds."""

    name: str
    hosts: tuple[str, ...]
    content: Callable[[Node], None] | None = None
    text: list[Callable[[str], str]] = field(default_factory=list)
    pages: list[tuple[str, Callable[[str], str]]] = field(default_factory=list)

    def matches(self, url: str) -> bool:
        host = re.sub(r"^[a-z+.-]+://([^/?#:]*).*$", r"\1", url.lower(), flags=re.S)
        return any(host == h or host.endswith("." + h) for h in self.hosts)


class Registry:
    """Adapters by name; ``pick("none")`` gives none, no name the first whose host fits."""

    def __init__(self, *adapters: Adapter):
        self.adapters = {a.name: a for a in adapters}

    def pick(self, url: str, name: str | None = None) -> Adapter | None:
        if name == "none":
            return None
        if name:
            return self.adapters[name]
        return next((a for a in self.adapters.values() if a.matches(url)), None)

    def clean(self, text: str, url: str, name: str | None = None) -> str:
        adapter = self.pick(url, name)
        if adapter:
            for step in [*adapter.text, *(change for pattern, change in adapter.pages if re.search(pattern, url))]:
                text = step(text)
        return text


def drop_copy_residue(text: str) -> str:
    """Lines that a copy button left."""
    return re.sub(r"(?mi)^[ \t]*(?:Copy|Copied!?|Copy page|Copy code)[ \t]*$\n?", "", text)


_IMAGES = r"((?:!\[[^\]]*\]\([^)]*\)\s*)+)"
_CARD_END = r"(?:\n+|)\]\(([^)\n]+)\)(?=\s*(?:\n|$|\[))"


def unwrap_cards(text: str) -> str:
    """Cards that are links as a whole: images, then a linked heading and the card's text. A card that ends in a label of its
    own keeps its heading and links the label. Empty links go, links that touch stand on lines of their own."""

    def titled(m: re.Match) -> str:
        images, title, body, url = (x.strip() for x in m.groups())
        mark = re.match(r"(#{1,6})\s+(.+)$", title)
        level, name = mark.groups() if mark else ("###", title)
        head = [images, ""] if images else []
        return "\n".join([*head, f"{level} [{name}]({url})", "", body, "", ""]) if body else m[0]

    def labelled(m: re.Match) -> str:
        heading, body, label, url = (x.strip() for x in m.groups())
        return f"{heading}\n\n{body}\n\n[{label}]({url})\n\n"

    text = re.sub(r"(?m)^\s*\[\]\([^)]+\)\s*$", "", text)
    text = re.sub(rf"\[\s*{_IMAGES}\n*(#{{1,6}}\s+[^\n]+|[^\n#!\[][^)\n]*)\n+([\s\S]*?){_CARD_END}", titled, text)
    text = re.sub(r"\[\s*\n+()(#{1,6}\s+[^\n]+)\n+([^\[\]]*?)\n+\]\(([^)\n]+)\)(?=\s*(?:\n|$|\[))", titled, text)
    text = re.sub(r"\[\s*\n+(#{1,6}\s+[^\n]+)\n+([^\[\]]*?)\n+([^\[\]\n]+)\]\(([^)\n]+)\)(?=\s*(?:\n|$|\[))", labelled, text)
    text = re.sub(r"(\[[^\]\n]+\]\([^)]+\))(?=\[[^\]\n]+\]\([^)]+\))", r"\1\n", text)
    return re.sub(r"(?m)^\[([^\n\]]+\[[^\]]+\]\([^)]+\)[^\n]*)$", r"\1", text)


def copied_prompts(text: str) -> str:
    """Cards of an image, a prompt and a copy mark as a list of the prompts."""
    one = r"!\[[^\]]*\]\([^)]*\)\s*([^!\n]+?)\s*Copied\s*"
    return re.sub(rf"(?:{one})+", lambda m: "\n".join(f"- {x.strip()}" for x in re.findall(one, m[0])), text)


def glued_tabs(labels: dict[str, list[str]]) -> Callable[[str], str]:
    """Lines that tab labels and their subtitles make without spaces, as lists."""
    return lambda text: "\n".join("\n".join(f"- {x}" for x in labels[line]) if line in labels else line for line in text.split("\n"))


def setup_cards(text: str) -> str:
    """Numbers of steps once, and no lines that only name a command."""
    return re.sub(r"(?m)^\s*[A-Za-z][A-Za-z\s]+ command\s*$", "", re.sub(r"(?m)^(\d+)\.\s+\1\s*$", r"\1.", text))


def index_page(text: str) -> str:
    """An index without its search links, its notice of no results, and lines of images alone."""
    search = r"\[[^\]]+\]\([^)]*\?search=[^)]+\)"
    text = re.sub(rf"(?m)^{search}(?:\s+{search})*\s*$", "", text)
    text = re.sub(r"(?m)^(?:#{1,6}\s+)?No [\w ]+ match these filters\s*\n+Try clearing a few filters[^\n]*$", "", text)
    return re.sub(r"(?m)^\s*(?:!\[[^\]]*\]\([^)]+\)\s*)+\s*$", "", text)


def strip_pager(text: str) -> str:
    """Links to the previous and next page at the end; their labels may run over lines."""
    link = r"\[\s*(?:Previous|Next)\b(?:(?!\]\()[\s\S])*\]\([^)]+\)"
    return re.sub(rf"(?i)(?:^|\n)\s*{link}(?:\s*{link})?\s*$", "\n", text)


def one_theme(text: str, theme: str = "light") -> str:
    """Of two neighbouring images of one subject in a light and a dark theme the one of ``theme``, its mode left out of the
    text. They are such a pair if their paths without -light, -dark and ending are equal, and their texts too or one is empty."""
    mode = r"(?i)\s*\((?:light|dark) mode\)\s*"

    def subject(target: str) -> str:
        path = re.sub(r"^[a-z]+://[^/]*|[?#].*$", "", target.split(' "')[0].strip())
        return re.sub(r"(?i)\.[a-z0-9]+$", "", re.sub(r"(?i)-(?:light|dark)(?=\.[a-z0-9]+$)", "", path)).lower()

    def one(m: re.Match) -> str:
        pair = [(m[1], m[2]), (m[3], m[4])]
        names = {" ".join(re.sub(mode, "", a).split()).lower() for a, _ in pair}
        if len({subject(t) for _, t in pair} | {""}) != 2 or len(names - {""}) > 1:
            return m[0]
        alt, target = next((p for p in pair if re.search(rf"(?i)(?:^|[-_/]){theme}(?:[-_.]|$)", p[1])), pair[0])
        return f"![{re.sub(mode, '', alt).strip()}]({target})"

    return re.sub(r"!\[([^\]]*)\]\(([^)]+)\)\s*!\[([^\]]*)\]\(([^)]+)\)", one, text)


def numbered_prompts(text: str) -> str:
    """Quoted prompts, one a line under a Prompts heading, as a list."""
    return re.sub(r"(?m)(^#+ Prompts\n+)((?:[“\"][^\n]*[”\"]\n?)+)", lambda m: m[1] + "".join(f"- {x}\n" for x in m[2].strip().split("\n")), text)


def tabs_to_headings(root: Node) -> None:
    """Panels of tabs under third-level headings with their labels."""
    labels = {n.attrs.get("aria-controls"): n.text().strip() for n in select(root, '[role="tab"]')}
    for panel in select(root, '[role="tabpanel"]'):
        if label := labels.get(panel.attrs.get("id")):
            head = Node("h3", parent=panel)
            head.children.append(label)
            panel.children.insert(0, head)
    for tabs in select(root, '[role="tablist"]'):
        tabs.remove()


def model_cards(cards: list[dict], notes: list[str] = ()) -> str:
    """Cards of models (name, description, command, features of title and value) as sections, and notes after them. Icons
    count against the most that any card has under the title."""
    features = [f for c in cards for f in c.get("features") or []]
    scale = {t: max(f.get("icons") or 0 for f in features if f["title"] == t) for t in {f["title"] for f in features}}

    def feature(f: dict) -> str:
        v = f.get("value")
        said = ("Yes" if v else "No") if isinstance(v, bool) else str(v or "").strip() or (f"{f['icons']}/{scale[f['title']]}" if f.get("icons") else "")
        return f"- {f['title']}" + (f": {said}" if said else "")

    def card(c: dict) -> str:
        command = f"```bash\n{c['command']}\n```" if c.get("command") else ""
        return "\n\n".join(x for x in (f"### {c['name']}", c.get("description"), command, "\n".join(map(feature, c.get("features") or []))) if x)

    return "\n\n".join([*map(card, cards), *notes])


def decode_props(text: str | None):  # noqa: ANN201
    """Serialized component props: [kind, payload] pairs, 0 a value or an object, 1 an array."""
    def one(x):  # noqa: ANN001, ANN202
        if not (isinstance(x, list) and len(x) == 2 and isinstance(x[0], int)):
            return x
        kind, v = x
        if kind == 1:
            return [one(y) for y in v]
        return {k: one(y) for k, y in v.items()} if isinstance(v, dict) else v

    return {k: one(v) for k, v in json.loads(text or "{}").items()}

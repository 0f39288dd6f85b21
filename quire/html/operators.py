"""HTML operators on DataFrames: one Arrow UDF a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.html.convert import Converter
from quire.html.select import compile_selector, first, matches, select
from quire.html.tree import BLOCKS, parse

#: What a printed page leaves out.
UNPRINTED = [
    "script", "noscript", "button", "input", "textarea", "select", "nav", "aside", '[role="navigation"]', '[role="complementary"]',
    '[id*="sidebar"]', '[class*="sidebar"]', ".table-of-contents", ".toc", "#on-this-page", ".on-this-page", '[aria-label="On this page"]',
    "#pagination", ".pagination", '[data-testid="breadcrumb"]', ".breadcrumbs", '[aria-label="breadcrumb"]', ".theme-toggle",
    ".dark-mode-toggle", "[data-theme-toggle]", ".copy-page", '[data-action="copy-page"]', ".page-copy-action", "[data-page-copy-action]",
]
#: Where lazy images keep their sources, in order.
LAZY = {"src": ["data-src", "data-original", "data-lazy-src", "data-echo"], "srcset": ["data-srcset"]}
TRANSLATABLE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "figcaption"}


def content(html: Column, selector: str) -> Column:
    """Inner HTML of the first match, or null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: node.html(False) if h is not None and (node := first(parse(h), selector)) else None)

    return run(html)


def page_markdown(converter: Converter, html: str | None, selector: str | None) -> str | None:
    if html is None:
        return None
    root = parse(html)
    node = first(root, selector) if selector else root
    return converter.convert(node) if node else None


def markdown(html: Column, selector: str | None = None, rules: dict | None = None) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        converter = Converter(rules)
        return s.map(lambda h: page_markdown(converter, h, selector))

    return run(html)


def _readable(selectors: list[str]) -> tuple[list, list[str]]:
    """Compiled selectors, and those that can't be read."""
    good, bad = [], []
    for x in selectors:
        try:
            good.append(compile_selector(x))
        except ValueError:
            bad.append(x)
    return good, bad


def _without(html: str | None, compiled: list) -> tuple[str, int]:
    """HTML without what selectors match, and how many elements went."""
    root, removed = parse(html), 0
    for alternatives in compiled:
        for node in [n for n in root.elements() if any(matches(n, steps) for steps in alternatives)]:
            node.remove()
            removed += 1
    return root.html(False), removed


def printed_markdown(html: Column, selector: str | None = None, remove: list[str] | None = None) -> Column:
    """``markdown`` of ``cleaned`` HTML in one UDF, so that a task has one worker."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        converter, (good, _) = Converter(), _readable(UNPRINTED + (remove or []))
        return s.map(lambda h: page_markdown(converter, _without(h, good)[0], selector))

    return run(html)


def cleaned(html: Column, selectors: list[str] | None = None) -> Column:
    """struct(html, removed, invalid): without what isn't printed; selectors that can't be read are reported."""

    @F.pandas_udf("html string, removed int, invalid array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        good, bad = _readable(UNPRINTED + (selectors or []))
        return pd.DataFrame([(*_without(h, good), bad) for h in s], columns=["html", "removed", "invalid"])

    return run(html)


def links(html: Column, selector: str, exclude: str | None = None) -> Column:
    """array<struct<href, text>> of matching links, without those that ``exclude`` or its descendants hold; an exclude
    that can't be read is ignored."""

    @F.pandas_udf("array<struct<href:string,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        try:
            compiled = compile_selector(exclude) if exclude else []
        except ValueError:
            compiled = []

        def hidden(node) -> bool:  # noqa: ANN001
            while node is not None:
                if any(matches(node, steps) for steps in compiled):
                    return True
                node = node.parent
            return False

        return s.map(lambda h: [{"href": n.attrs["href"], "text": " ".join(n.text().split())} for n in select(parse(h), selector) if n.attrs.get("href") and not hidden(n)])

    return run(html)


def title(html: Column, selector: str) -> Column:
    """struct(title, source): document title, h1 in the content, an element of class title, h2 or h3, any h1."""

    @F.pandas_udf("title string, source string")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(h: str | None) -> tuple:
            root = parse(h)
            body = first(root, selector) or parse("")
            tries = [("document", first(root, "title")), ("content-h1", first(body, "h1")), ("title-class", first(body, '[class*="title"]')), ("subheading", first(body, "h2, h3")), ("page-h1", first(root, "h1"))]
            return next(((t, name) for name, n in tries if n and (t := " ".join(n.text().split()))), (None, "none"))

        return pd.DataFrame([one(h) for h in s], columns=["title", "source"])

    return run(html)


def expanded(html: Column) -> Column:
    """Details open, aria-expanded true, hidden parts shown except dialogs and navigation, lazy sources promoted."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(h: str | None) -> str | None:
            root = parse(h)
            for n in root.elements():
                if n.tag == "details":
                    n.attrs["open"] = ""
                if n.attrs.get("aria-expanded") == "false":
                    n.attrs["aria-expanded"] = "true"
                if ("hidden" in n.attrs or n.attrs.get("aria-hidden") == "true") and n.tag not in ("dialog", "nav") and n.attrs.get("role") not in ("dialog", "navigation"):
                    n.attrs.pop("hidden", None)
                    n.attrs.pop("aria-hidden", None)
                if n.tag in ("img", "source"):
                    for to, names in LAZY.items():
                        held = next((n.attrs[k] for k in names if n.attrs.get(k)), None)
                        if held and (not n.attrs.get(to) or n.attrs[to].startswith("data:")):
                            n.attrs[to] = held
                if n.classes & {"dark"}:
                    n.attrs["class"] = " ".join(c for c in n.attrs["class"].split() if c != "dark")
                if n.attrs.get("data-theme") == "dark":
                    n.attrs["data-theme"] = "light"
            return root.html(False)

        return s.map(one)

    return run(html)


def translatable(html: Column) -> Column:
    """array<struct<n, tag, text>> of text elements without block children, outside code and what isn't to be translated."""

    @F.pandas_udf("array<struct<n:int,tag:string,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        def one(h: str | None) -> list:
            out = []
            for n in parse(h).elements():
                up, skip = n, n.tag not in TRANSLATABLE or any(c.tag in BLOCKS for c in n.elements())
                while up is not None and not skip:
                    skip, up = up.tag in ("pre", "code", "nav") or "no-translate" in up.classes, up.parent
                text = " ".join(n.text().split())
                if not skip and len(text) >= 2 and any(c.isalpha() for c in text):
                    out.append({"n": len(out), "tag": n.tag, "text": text})
            return out

        return s.map(one)

    return run(html)

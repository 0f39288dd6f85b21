"""Checks of rendered books, over tables of pages, spans, links and outlines. Each rule is a query; issues are a union."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.misc import contains_text, fonts_match
from quire.markdown.transform import annotation_violations

#: Types of annotations.
ANNOTATION_TYPES = ["word", "phrasal-verb", "idiom", "collocation", "native-expression", "technical-term", "slang", "grammar-pattern", "discourse-logic", "register-usage", "writing-pattern", "concept"]


def _issues(rows: DataFrame, kind: str, when: Column, detail: Column) -> DataFrame:
    return rows.where(when).select(F.lit(kind).alias("kind"), "page", detail.cast("string").alias("detail"))


def page_issues(pages: DataFrame, width: float, height: float) -> DataFrame:
    """page_size (over one point off), replacement_character, missing_glyph, empty_page."""
    parts = [
        _issues(pages, "page_size", (F.abs(F.col("width") - width) > 1) | (F.abs(F.col("height") - height) > 1), F.concat_ws("x", "width", "height")),
        _issues(pages, "replacement_character", F.col("text").contains("�"), F.lit("")),
        _issues(pages, "missing_glyph", F.col("missing_glyphs") > 0, F.col("missing_glyphs")),
        _issues(pages, "empty_page", (F.trim("text") == "") & (F.col("images") == 0), F.lit("")),
    ]
    return reduce(DataFrame.unionByName, parts)


def overflow(spans: DataFrame, pages: DataFrame, left: float, right: float, top: float, bottom: float, header: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Boxes outside the page (2 points allowed) or the text block; text may stand higher or lower by 40 % of its height,
    4 points at least. A page's own label in the foot and text in the header zone are allowed."""
    s = spans.join(pages.select("page", "width", "height", "label"), "page")
    slack = F.when(F.col("kind") == "image", 2.0).otherwise(F.greatest(F.lit(4.0), (F.col("y1") - F.col("y0")) * 0.4))
    beyond = (F.col("x0") < -2) | (F.col("x1") > F.col("width") + 2) | (F.col("y0") < -2) | (F.col("y1") > F.col("height") + 2)
    outside = (F.col("x0") < left - 2) | (F.col("x1") > F.col("width") - right + 2) | (F.col("y0") < top - slack) | (F.col("y1") > F.col("height") - bottom + slack)
    middle = (F.col("y0") + F.col("y1")) / 2
    head = (F.col("kind") == "text") & middle.between(*header)
    foot = (F.trim("text") == F.col("label")) & (middle >= F.col("height") - bottom) & (F.col("x0") > F.col("width") * 0.35) & (F.col("x1") < F.col("width") * 0.65)
    return _issues(s, "overflow", beyond | (outside & ~head & ~foot), F.col("text"))


def link_issues(links: DataFrame, pages: DataFrame) -> DataFrame:
    known = pages.select(F.col("page").alias("target"))
    return _issues(links.join(known, "target", "left_anti"), "invalid_link", F.lit(True), F.col("target"))


def bookmark_issues(entries: DataFrame, pages: DataFrame, require_toc: bool = False) -> DataFrame:
    """invalid_bookmark, and titles that their page doesn't hold; entries with children need none unless asked."""
    joined = entries.join(pages.select("page", "text"), "page", "left")
    must = F.lit(True) if require_toc else ~F.col("has_children")
    bad = _issues(joined, "invalid_bookmark", F.col("text").isNull(), F.col("title"))
    return bad.unionByName(_issues(joined, "bookmark_title", must & ~contains_text(F.col("title"), F.col("text")), F.col("title")))


def toc_number_issues(links: DataFrame, pages: DataFrame) -> DataFrame:
    target = pages.select(F.col("page").alias("target"), F.col("label").alias("expected"))
    return _issues(links.where("printed is not null").join(target, "target"), "toc_page_number", F.col("printed") != F.col("expected"), F.col("printed"))


def article_issues(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """Titles that aren't exactly one bookmark of level 2."""
    counts = entries.where("level = 2").groupBy("title").agg(F.count("*").alias("n"))
    rows = titles.join(counts, "title", "left").where("coalesce(n, 0) <> 1")
    return rows.select(F.lit("article_bookmark").alias("kind"), F.lit(None).cast("long").alias("page"), F.col("title").alias("detail"))


def missing(expected: DataFrame, found: DataFrame, key: str, kind: str) -> DataFrame:
    rows = expected.select(key).join(found.select(key), key, "left_anti")
    return rows.select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("page"), F.col(key).alias("detail"))


def font_issues(required: DataFrame, used: DataFrame) -> DataFrame:
    """Required fonts that no used font matches; both are short lists of names."""
    rows = required.join(used, fonts_match(F.col("font"), F.col("used")), "left_anti")
    return rows.select(F.lit("missing_font").alias("kind"), F.lit(None).cast("long").alias("page"), F.col("font").alias("detail"))


_PLAIN = str.maketrans("‘’“”", "''\"\"") | dict(zip(map(ord, "ﬀﬁﬂﬃﬄﬅﬆ"), ["ff", "fi", "fl", "ffi", "ffl", "st", "st"], strict=True))


def _compact(text: str) -> str:
    return "".join(text.translate(_PLAIN).split())


def whole_book(pages: list[dict], outline: list[dict], toc_targets: list[str], expected: dict) -> list[dict]:
    """missing_body_content, empty_article_body, missing_toc, toc_targets, missing_image of one book, everything in order.
    Pages count from 1 without gaps; those with Roman labels are the table of contents."""
    out: list[dict] = []
    add = lambda kind, page=None, detail="": out.append({"kind": kind, "page": page, "detail": detail})
    toc = [bool(re.fullmatch("[ivxlcdm]+", p["label"] or "")) for p in pages]
    body = "\n".join(p["text"] or "" for p, t in zip(pages, toc, strict=True) if not t)
    plain = _compact(body)
    absent = [x for x in expected["snippets"] if _compact(x) not in plain]
    joined = _compact(re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", body)) if absent else ""
    for snippet in absent:
        if _compact(snippet) not in joined:
            add("missing_body_content", detail=snippet)
    headings = [_compact(e["title"]) for e in outline]
    for title in expected["titles"]:
        places = [k for k, e in enumerate(outline) if e["level"] == 2 and e["title"] == title]
        if len(places) != 1:
            continue  # article_issues has it
        start = outline[places[0]]["page"] - 1
        end = next((e["page"] - 1 for e in outline[places[0] + 1 :] if e["level"] <= 2), len(pages))
        text = _compact("\n".join(p["text"] or "" for p in pages[start:end]))
        for h in headings:
            text = text.replace(h, "") if h else text
        if not re.search(r"[^\W\d_]", text) and not any(p["images"] for p in pages[start:end]):
            add("empty_article_body", start + 1, title)
    if expected["require_toc"]:
        if not outline or sum(toc) < expected["min_toc_pages"]:
            add("missing_toc")
        if list(dict.fromkeys(toc_targets)) != [e["target"] for e in outline]:
            add("toc_targets", detail=f"{len(set(toc_targets))}/{len(outline)}")
    if expected["require_images"] and not any(p["images"] for p in pages):
        add("missing_image")
    return out


def book_issues(books: DataFrame, pages: DataFrame, outline: DataFrame, toc_links: DataFrame) -> DataFrame:
    """(book, kind, page, detail) by ``whole_book``. books: book, expected struct<snippets, titles, require_toc,
    min_toc_pages, require_images>; pages: book, page, label, text, images; outline: book, position, level, title, page,
    target; toc_links: book, n, target. One book is one value."""
    listed = lambda rows, name, *cols: rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    @F.pandas_udf("array<struct<kind:string,page:long,detail:string>>")
    def run(p: pd.Series, o: pd.Series, t: pd.Series, e: pd.DataFrame) -> pd.Series:
        some = lambda x: [] if x is None else list(x)
        rows = zip(p, o, t, e.to_dict("records"), strict=True)
        return pd.Series([whole_book(some(a), some(b), [x["target"] for x in some(c)], d) for a, b, c, d in rows], dtype=object)

    out = books.join(listed(pages, "pages", "page", "label", "text", "images"), "book", "left")
    out = out.join(listed(outline, "outline", "position", "level", "title", "page", "target"), "book", "left").join(listed(toc_links, "links", "n", "target"), "book", "left")
    return out.select("book", F.explode(run("pages", "outline", "links", "expected")).alias("i")).select("book", "i.*")


def verdict(issues: DataFrame, most: int = 12) -> DataFrame:
    """issues, passed, and the first pages with issues."""
    first = issues.where("page is not null").select("page").distinct().orderBy("page").limit(most)
    pages = first.agg(F.array_sort(F.collect_list("page")).alias("preview_pages"))
    return issues.agg(F.count("*").alias("issues"), (F.count("*") == 0).alias("passed")).join(pages)  # one row each


def layout_issues(specs: DataFrame) -> DataFrame:
    """Margins that leave no body, and header or footer zones that don't fit their margin."""
    checks = {
        "no_body_width": F.col("left") + F.col("right") >= F.col("width"),
        "no_body_height": F.col("top") + F.col("bottom") >= F.col("height"),
        "header_zone": F.col("header") > F.col("top"),
        "footer_zone": F.col("footer") > F.col("bottom"),
    }
    return specs.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("rule"))


def response_guards(rows: DataFrame, domains: list[str], most_bytes: int) -> DataFrame:
    """The first reason to refuse a fetched resource, or null: scheme, credentials, domain, address, size, type."""
    from quire.functions import url as U

    u = F.col("url")
    reason = (
        F.when(~F.lower(U.part(u, 1)).isin("http", "https"), "scheme")
        .when(U.part(u, 2).contains("@"), "credentials")
        .when(~U.exact_host(u, domains), "domain")
        .when(U.is_private(F.col("address")), "address")
        .when(F.col("bytes") > most_bytes, "size")
        .when(~F.coalesce(F.col("content_type").rlike("^(text/|application/(json|xml))"), F.lit(False)), "type")
    )
    return rows.withColumn("refused", reason)


def annotation_issues(rows: DataFrame) -> DataFrame:
    """Shape of annotations: lengths, counts, Han characters, sentences."""
    han = r"\p{IsHan}"
    checks = {
        "quote": ~F.length("quote").between(1, 120),
        "occurrence": F.col("occurrence") < 1,
        "explanation": ~F.length("explanation").between(1, 240) | ~F.col("explanation").rlike(han),
        "example": ~F.length("example").between(1, 240) | (F.size(F.regexp_extract_all(F.col("example"), F.lit(r"([A-Za-z]+)"), 1)) < 3),
        "prompt": (F.length("prompt") > 160) | ((F.col("prompt") != "") & ~F.col("prompt").rlike(han)),
    }
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("rule"))


def annotation_type_issues(rows: DataFrame) -> DataFrame:
    """The rule of ``annotation_issues`` that needs a column type: one of the known types."""
    known = F.coalesce(F.col("type").isin(ANNOTATION_TYPES), F.lit(False))
    return rows.where(~known).select("id", F.lit("type").alias("rule"))


def coverage_issues(segments: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, rule): segments without an answer, answers that no segment asked for, and ids answered more than once."""
    counts = answers.groupBy("id").agg(F.count("*").alias("n"))
    rule = lambda rows, name: rows.select("id", F.lit(name).alias("rule"))
    missing_, extra = segments.join(counts, "id", "left_anti"), counts.join(segments, "id", "left_anti")
    return rule(missing_, "missing").unionByName(rule(extra, "extra")).unionByName(rule(counts.where("n > 1"), "repeated"))


def response_issues(segments: DataFrame, answers: DataFrame, most: int) -> DataFrame:
    """Coverage, and for each answer to a segment density, prompts, place, protection and overlap. segments: id, text,
    protected array<struct<start, end>>; answers: id, annotations array<struct<quote, occurrence, prompt>>."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series, protected: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str, p: list | None, f: list | None) -> list[str]:
            segment = {"text": t, "protected": [(x["start"], x["end"]) for x in ([] if p is None else p)]}
            given = [{k: x[k] for k in ("quote", "occurrence", "prompt")} for x in ([] if f is None else f)]
            return annotation_violations(segment, given, most)

        return pd.Series([one(*x) for x in zip(text, protected, found, strict=True)], dtype=object)

    broken = segments.join(answers, "id").select("id", F.explode(run("text", "protected", "annotations")).alias("rule"))
    return coverage_issues(segments, answers).unionByName(broken)


def resolve_packs(packs: DataFrame, asked: DataFrame, layout: str, spec: str = "spec", order: str = "seq") -> DataFrame:
    """``asked`` with the spec of its layout, its fingerprint (SHA-256 of the JSON, fields in the order of their names) and
    issue: unknown, or duplicate where several packs have the id, of which the first counts."""
    json = F.to_json(F.struct(*[F.col(f"{spec}.{c}").alias(c) for c in sorted(packs.schema[spec].dataType.names)]))
    first = packs.groupBy(F.col(f"{spec}.id").alias(layout)).agg(F.min_by(json, order).alias("__json"), F.count("*").alias("__n"))
    out = asked.join(first, layout, "left").withColumn("fingerprint", F.sha2("__json", 256))
    return out.withColumn("issue", F.when(F.col("__n").isNull(), "unknown").when(F.col("__n") > 1, "duplicate")).withColumnRenamed("__json", "spec").drop("__n")

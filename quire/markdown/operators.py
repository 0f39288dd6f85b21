"""Markdown operators on DataFrames: one Arrow UDF a document, errors as a column."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.html.convert import Converter
from quire.html.operators import page_markdown
from quire.markdown import fences, mdx, transform
from quire.markdown.adapters import Registry


def mapped(text: Column, change: Callable[[str], str]) -> Column:
    """``change`` of each text; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else change(t))

    return run(text)


def prose_mapped(text: Column, change: Callable[[str], str], inline: bool = False) -> Column:
    return mapped(text, lambda t: fences.map_prose(t, change, inline))


def segments(text: Column) -> Column:
    """array<struct<type, text>>."""

    @F.pandas_udf("array<struct<type:string,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else [{"type": k, "text": v} for k, v in fences.segments(t)])

    return run(text)


def images(text: Column) -> Column:
    @F.pandas_udf("array<struct<type:string,start:int,end:int,alt:string,url:string,title:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else transform.image_references(t))

    return run(text)


def with_images(text: Column, resolved: Column) -> Column:
    """struct(markdown, missing) with remote images at the addresses of a map."""

    @F.pandas_udf("markdown string, missing array<string>")
    def run(s: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([transform.rewrite_images(t or "", dict(r if r is not None else {})) for t, r in zip(s, m, strict=True)], columns=["markdown", "missing"])

    return run(text, resolved)


def from_mdx(text: Column, page: Column, theme: str = "light") -> Column:
    """struct(markdown, error)."""

    @F.pandas_udf("markdown string, error string")
    def run(s: pd.Series, p: pd.Series) -> pd.DataFrame:
        def one(t: str | None, url: str | None) -> tuple:
            try:
                return (None if t is None else mdx.strip_mdx(t, url, theme)), None
            except ValueError as e:
                return None, str(e)

        return pd.DataFrame([one(*x) for x in zip(s, p, strict=True)], columns=["markdown", "error"])

    return run(text, page)


def plan(text: Column, bilingual: bool = False) -> Column:
    kind = "lines array<string>, segments array<struct<id:string,text:string>>, captions array<struct<id:string,alt:string,line:int>>"

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([transform.translation_plan(t or "", bilingual) for t in s], columns=["lines", "segments", "captions"])

    return run(text)


def annotation_segments(text: Column) -> Column:
    kind = "array<struct<id:string,text:string,start:int,end:int,indent:int,protected:array<struct<start:int,end:int>>>>"

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else [x | {"protected": [{"start": a, "end": b} for a, b in x["protected"]]} for x in transform.annotation_segments(t)])

    return run(text)


def adapted(text: Column, url: Column, registry: Registry, name: str | None = None) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else registry.clean(t, url or "", name) for t, url in zip(s, u, strict=True)], dtype=object)

    return run(text, url)


def adapted_page(html: Column, url: Column, registry: Registry, selector: str | None = None, name: str | None = None) -> Column:
    """struct(markdown, adapted) of a page's HTML in one UDF, so that a task has one worker."""

    @F.pandas_udf("markdown string, adapted string")
    def run(s: pd.Series, u: pd.Series) -> pd.DataFrame:
        converter = Converter()

        def one(h: str | None, page: str | None) -> tuple:
            md = page_markdown(converter, h, selector)
            return md, None if md is None else registry.clean(md, page or "", name)

        return pd.DataFrame([one(*x) for x in zip(s, u, strict=True)], columns=["markdown", "adapted"])

    return run(html, url)

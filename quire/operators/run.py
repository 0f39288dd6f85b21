"""A whole run: raw URLs and fetched pages to Markdown, manifest, issues and one book a section."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import url as U
from quire.html import operators as H
from quire.markdown import operators as K
from quire.markdown import transform
from quire.markdown.adapters import Registry
from quire.operators import book, frontier, state
from quire.storage import Scratch


@dataclass
class Settings:
    """What a run acquires and how it reads it."""

    domains: list[str]
    base: str = ""
    ignored: tuple[str, ...] = ()
    content: str = "article"
    remove: tuple[str, ...] = ()
    frontmatter: bool = True
    adapters: Registry | None = None
    adapter: str | None = None


@dataclass
class Result:
    """Tables of a run; ``articles``: final_index, url, title, markdown, sha256."""

    frontier: DataFrame
    articles: DataFrame
    manifest: DataFrame
    missing: DataFrame
    books: DataFrame


def run(raw: DataFrame, pages: DataFrame, settings: Settings, done: DataFrame | None = None) -> Result:
    """``raw``: raw_index, url, section; ``pages``: url, html; ``done``: url, sha256 of HTML already converted, which is
    not converted again. URLs meet pages by their normal form."""
    wanted = frontier.unique(frontier.select(raw, settings.domains, settings.base, list(settings.ignored)))
    front = frontier.dense_index(wanted)
    fetched = pages.select(U.normalize(F.col("url")).alias("normal"), "html", F.sha2("html", 256).alias("source_sha"))
    if done is not None:
        fetched = fetched.join(done.select(F.col("sha256").alias("source_sha")).distinct(), "source_sha", "left_anti")
    one = frontier.unique(fetched.withColumn("__o", F.col("source_sha")), "normal", "__o")
    joined = front.select("final_index", "url", "normal", "section").join(one.select("normal", "html"), "normal", "left")
    there = joined.where("html is not null").withColumn("title", T.clean_title(T.html_title(F.col("html"))))
    body = there.withColumn("markdown", H.printed_markdown(F.col("html"), settings.content, list(settings.remove))).drop("html")
    if settings.adapters:
        body = body.withColumn("markdown", K.adapted(F.col("markdown"), F.col("url"), settings.adapters, settings.adapter))
    body = body.withColumn("markdown", T.collapse_blank_lines(F.col("markdown")))
    if settings.frontmatter:
        body = body.withColumn("markdown", T.add_frontmatter(F.col("markdown"), [("title", F.nullif("title", F.lit(""))), ("source", F.col("url"))]))
    articles = Scratch(raw.sparkSession).put(body.withColumn("sha256", F.sha2("markdown", 256)), "articles")  # pages are converted once for all tables
    manifest = articles.select(F.col("final_index").cast("string").alias("index"), "url", U.output_name(F.col("url"), F.col("final_index")).alias("path"), "sha256")
    ready = articles.select(F.col("final_index").alias("index"), "section", "title", K.mapped(T.without_frontmatter(F.col("markdown")), lambda t: transform.article(t)).alias("body"))
    return Result(front, articles, manifest, joined.where("html is null").select("final_index", "url"), book.assemble(ready, ["section"]))


def resume(result: Result, files: DataFrame) -> DataFrame:
    """Articles whose file is unchanged."""
    return state.resumable(result.manifest, files)

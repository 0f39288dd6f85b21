"""Queries on HTML and Markdown trees, derived content and streams; tests hold golden results."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.html import operators as H
from quire.markdown import adapters, transform
from quire.markdown import operators as K
from quire.operators import derive, verify
from quire.plans.registry import query
from quire.plans.registry import table as plain_table
from quire.session import ship
from quire.storage import Scratch, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return plain_table(spark, sf_dir, name)


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown."""
    return table(spark, sf_dir, "pages").select("page_id", "url", H.markdown(F.col("html"), "article").alias("md"))


def exploded(rows: DataFrame) -> DataFrame:
    """(page_id, s): a row for each item of the array ``all``. A plain explode asks for arrays that aren't empty first, and
    with that condition the UDF behind the array would run twice."""
    return rows.select("page_id", F.explode_outer("all").alias("s")).where("s is not null")


@query()
def content_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT1, SRC8, HT12, F3."""
    rows = table(spark, sf_dir, "pages").select("page_id", H.content(F.col("html"), "article").alias("content"), H.cleaned(F.col("html"), [".ad", "p:bad("]).alias("c"))
    return rows.select("page_id", F.md5("content").alias("content"), "c.removed", "c.invalid")


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT5, HT6, HT8, HT9, HT10, HT11, X2, MD1, MD3."""
    page = transform.absolute_urls
    return written(spark, sf_dir).select("page_id", K.mapped(F.col("md"), lambda t: transform.split_glued_images(page(t, "https://example.org/"))).alias("markdown"))


@query()
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT2, HT13, HT16, HT17."""
    h = F.col("html")
    rows = table(spark, sf_dir, "pages").select("page_id", H.title(h, "article").alias("t"), H.links(h, "nav a", ".ad").alias("links"), H.translatable(h).alias("parts"), F.md5(H.expanded(h)).alias("expanded"))
    return rows.select("page_id", "t.title", "t.source", F.size("links").alias("links"), F.col("links")[0]["text"].alias("first_link"), F.size("parts").alias("parts"), "expanded")


@query()
def fence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1-FN5, W14, MD25."""
    rows = written(spark, sf_dir).withColumn("md", F.concat("md", F.lit("\n\n```py\n# x\n```\n\n# end")))
    return rows.select("page_id", F.size(K.segments(F.col("md"))).alias("segments"), F.md5(K.mapped(F.col("md"), transform.demote_headings)).alias("demoted"))


@query()
def markdown_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD7-MD10, MD12, MD14-MD16, MD19, MD20, MD24, MD34, W17, O7."""
    return written(spark, sf_dir).select("page_id", K.mapped(F.col("md"), lambda t: transform.link_spacing(transform.article(t))).alias("article"))


@query()
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD17, MD18, SO1, SO2."""
    rows = written(spark, sf_dir).withColumn("md", F.concat("md", F.lit("\n\n![a [b]](https://x.org/i.png \"t\") <img src='https://x.org/j.png'>")))
    rows = rows.withColumn("new", K.with_images(F.col("md"), F.create_map(F.lit("https://x.org/i.png"), F.lit("i.png"))))
    return rows.select("page_id", F.transform(K.images(F.col("md")), lambda x: x["url"]).alias("urls"), "new.missing")


@query()
def mdx_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5."""
    source = F.concat(F.lit('import A from "a"\n\n<Note>'), "url", F.lit("</Note>\n"), F.when(F.col("page_id") % 2 == 0, "{1}").otherwise("{call()}"))
    return table(spark, sf_dir, "pages").select("page_id", K.from_mdx(source, F.col("url")).alias("r")).select("page_id", "r.markdown", "r.error")


@query()
def site_adapter_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD35, MD36, MD37, X1, A13: on one site only."""
    site = adapters.Adapter("docs", ("example.org",), adapters.tabs_to_headings, [adapters.drop_copy_residue, adapters.unwrap_cards, adapters.one_theme, adapters.numbered_prompts, adapters.strip_pager])
    md = F.lit("Copy\n\ntext\n\n[Next page](/b)\n")
    return table(spark, sf_dir, "pages").select("page_id", K.adapted(md, F.col("url"), adapters.Registry(site)).alias("markdown"))


def text_rules(text: Column) -> dict[str, Column]:
    """HT7, A19, MD2, MD4, W9, W10, MD22, F8, F15, MD27 on a whole text; long results as their hash."""
    spans, paragraphs = F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), 1), F.split(text, r"\n{2,}", -1)
    return {
        "heading": T.title_from(text),
        "code": F.md5(T.inline_code(text)),
        "longest": T.longest_backticks(text),
        "images": F.md5(T.drop_repeated_images(text)),
        "captions": F.md5(T.drop_repeated_captions(text)),
        "emphasis": F.md5(T.cjk_emphasis(text)),
        "breaks": F.size(F.filter(spans, T.needs_breaks)),
        "pipe_tables": F.size(F.filter(paragraphs, T.is_pipe_table)),
    }


@query()
def document_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT7, A19, MD2, MD4, W9, W10, MD22, F8, F15, MD27 on the texts of documents."""
    return plain_table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text_rules(F.col("text")).items()])


@query()
def page_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, MD23, MD26 and MD35 on pages: titles from their HTML, the rest from their Markdown."""
    site = adapters.Adapter("docs", ("example.org",), None, [adapters.drop_copy_residue, adapters.unwrap_cards, adapters.one_theme, adapters.numbered_prompts, adapters.strip_pager])
    rows = table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), K.adapted_page(F.col("html"), F.col("url"), adapters.Registry(site), "article").alias("both"))
    rows = rows.select("page_id", "title", F.col("both.markdown").alias("md"), "both.adapted")
    more = {"title": T.clean_title(F.col("title")), "body": F.md5(T.without_leading_title(F.col("md"), F.col("title"))), "adapted": F.md5("adapted")}
    return rows.select("page_id", *[c.alias(n) for n, c in (more | text_rules(F.col("md"))).items()])


@query()
def verify_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of ten pages and a table of contents. What is expected comes from the table; the book lost the text of
    some pages, and some books their table of contents or one of its links."""
    k, at = F.col("page_id"), (F.col("page_id") % 10 + 2).alias("page")
    text = F.regexp_replace(T.strip_nontext(F.col("html")), "<[^>]+>", " ")
    rows = table(spark, sf_dir, "pages").select(k, F.floor(k / 10).alias("book"), at, F.concat(F.lit("Article "), k.cast("string")).alias("title"), text.alias("text"), F.regexp_count("html", F.lit("(?i)<img")).alias("images"), F.regexp_extract("html", r"(?i)<p[^>]*>([^<]*\w[^<]*)</p>", 1).alias("snippet"))
    each = rows.groupBy("book")
    snippets = F.filter(F.array_sort(F.collect_set("snippet")), lambda x: x != "")
    books = each.agg(F.struct(snippets.alias("snippets"), F.array_sort(F.collect_list("title")).alias("titles"), F.lit(True).alias("require_toc"), F.lit(1).alias("min_toc_pages"), F.lit(True).alias("require_images")).alias("expected"))
    lost = k % 17 == 4
    kept = rows.select("book", "page", F.col("page").cast("string").alias("label"), F.concat("title", F.lit("\n"), F.when(lost, "").otherwise(F.col("text"))).alias("text"), F.when(lost, 0).otherwise(F.col("images")).alias("images"))
    front = each.agg(F.count("*")).select("book", F.lit(1).cast("long").alias("page"), F.when(F.col("book") % 5 == 1, "1").otherwise("i").alias("label"), F.lit("Contents").alias("text"), F.lit(0).alias("images"))
    outline = rows.select("book", F.col("page").alias("position"), F.lit(2).alias("level"), "title", "page", F.col("title").alias("target"))
    links = outline.where("not (book % 7 = 2 and page = 3)").select("book", F.col("position").alias("n"), "target")
    return verify.book_issues(books, front.unionByName(kept), outline, links)


@query()
def translated_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD28, MD29, X4, X6, J8: plans, cache look-up, a client that marks its texts, answers by segment."""
    plans = written(spark, sf_dir).select("page_id", K.plan(F.col("md"))["segments"].alias("all"))
    rows = exploded(plans).select(F.concat_ws("/", "page_id", "s.id").alias("id"), F.md5("s.text").alias("key"), "s.text")
    rows = Scratch(spark).put(rows, "segments")  # read for the look-up and for the client
    cache = spark.createDataFrame([], "key string, derived string")
    out = derive.derive(rows, cache, derive.retrying(lambda batch: {k: f"T({v})" for k, v in batch.items()}))
    return out.groupBy(F.substring_index("id", "/", 1).alias("page_id")).agg(F.count("*").alias("segments"), F.count("derived").alias("done"))


@query()
def annotation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD30, MD31, MD32, X5."""
    rows = exploded(written(spark, sf_dir).select("page_id", K.annotation_segments(F.col("md")).alias("all")))
    return rows.select("page_id", "s.id", "s.start", "s.end", F.size("s.protected").alias("protected"))


@query()
def annotation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2, V3 (type), V4, V5: answers to all segments of all pages, some of them wrong by the number of their page."""
    rows = exploded(written(spark, sf_dir).select("page_id", K.annotation_segments(F.col("md")).alias("all")))
    k = F.col("page_id") % 9
    segments = rows.select("page_id", F.concat_ws("/", "page_id", "s.id").alias("id"), "s.text", "s.protected")
    segments = Scratch(spark).put(segments, "segments")  # read by each rule and by the answers
    note = lambda n, kind="word": F.struct(F.when(k == 4, "no such quote").otherwise(F.substring("text", 1, 1)).alias("quote"), F.lit(n).alias("occurrence"), F.when(k == 3, "问").otherwise("").alias("prompt"), F.when(k == 5, "odd").otherwise(kind).alias("type"))
    one, two, three = F.array(note(1)), F.array(note(1), note(1)), F.array(note(1), note(1), note(1), note(1))
    answers = segments.where(k != 0).select(F.when(k == 1, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), F.explode(F.array_repeat(F.when(k == 2, three).when(k == 3, two).otherwise(one), F.when(k == 6, 2).otherwise(1))).alias("annotations"))
    types = answers.select("id", F.explode("annotations.type").alias("type"))
    return verify.response_issues(segments, answers, 3).unionByName(verify.annotation_type_issues(types))


@query()
def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2, ST7: the events as a stream, one state for each URL."""
    from quire.streaming import status as S

    ship(spark)
    import uuid

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    names = ["success", "failed", "retrying", "skipped", "processing"]
    stream = spark.readStream.schema("event_id long, user_id long").parquet(f"{sf_dir}/events.parquet*")
    events = stream.select(F.col("user_id").alias("url"), F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int")).alias("status"), F.col("event_id").alias("event_seq"))
    S.run_updates(S.latest(events), f"{root}/out", f"{root}/state")
    return S.settled(spark, f"{root}/out")


@query()
def book_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on the pages: frontier, conversion, manifest and one book for each host."""
    from quire.functions import url as U
    from quire.operators import run

    pages = table(spark, sf_dir, "pages")
    raw = pages.select(F.col("page_id").alias("raw_index"), "url", U.host(F.col("url")).alias("section"))
    result = run.run(raw, pages.select("url", "html"), run.Settings(["example.com"], ignored=("casino",), remove=(".ad",)))
    return result.books.select("section", "articles", F.length("markdown").alias("length"))

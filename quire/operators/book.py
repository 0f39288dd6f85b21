"""Books: page offsets, outlines, assembly and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start_pages(files: DataFrame, order: str = "index", count: str = "page_count", book: str = "book", block: int = 50_000) -> DataFrame:
    """First page (from 1) of each file: the pages of all before it in its book, by a numeric ``order``.

    A book is summed in blocks of ``block`` places, pre-aggregated; places are numbered inside them, so no task takes more
    than a block of a book's files.
    """
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = files.withColumn("__block", F.floor(F.col(order) / block))
    sums = rows.groupBy(book, "__block").agg(F.sum(count).alias("__pages"))
    before = sums.select(book, "__block", F.coalesce(F.sum("__pages").over(until(Window.partitionBy(book).orderBy("__block"))), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(count).over(until(Window.partitionBy(book, "__block").orderBy(order))), F.lit(0))
    return rows.join(before, [book, "__block"]).withColumn("start_page", F.col("__before") + inside + 1).drop("__block", "__before")


def outline(pages: DataFrame, book: str = "book", block: int = 50_000) -> DataFrame:
    """(book, seq, level, title, page): a section at the first page that it has, then its articles, by a numeric index.

    Numbered as ``start_pages`` sums: places inside blocks of ``block`` indexes, and counts of the blocks before.
    """
    section = pages.groupBy(book, "section").agg(F.min_by("start_page", "index").alias("page"), F.min("index").alias("index"))
    heads = section.select(book, "index", F.lit(1).alias("level"), F.col("section").alias("title"), "page")
    rows = heads.unionByName(pages.select(book, "index", F.lit(2).alias("level"), "title", F.col("start_page").alias("page"))).withColumn("__block", F.floor(F.col("index") / block))
    sums = rows.groupBy(book, "__block").agg(F.count("*").alias("__size"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__size").over(Window.partitionBy(book).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(book, "__block").orderBy("index", "level"))
    out = rows.join(sums.drop("__size"), [book, "__block"]).withColumn("seq", F.col("__before") + inside)
    return out.drop("index", "__block", "__before")


def ranges(entries: DataFrame, book: str = "book", block: int = 50_000) -> DataFrame:
    """has_children, and for each entry the page at which the next entry of level 1 or 2 begins (null: to the end).

    Frames run backwards from the end of a block of ``block`` entries, so each entry is added once; what lies after a block
    is its followers' first level and first such page.
    """
    opens, key = F.when(F.col("level") <= 2, F.col("page")), [book, "__block"]
    later = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = entries.withColumn("__block", F.floor((F.col("seq") - 1) / block))
    firsts = rows.groupBy(*key).agg(F.min_by("level", "seq").alias("__level"), F.min_by(opens, F.when(opens.isNotNull(), F.col("seq"))).alias("__page"))
    over = Window.partitionBy(book).orderBy(F.desc("__block"))
    after = firsts.select(*key, F.lag("__level").over(over).alias("__level"), later(F.col("__page"), over).alias("__page"))
    inside = Window.partitionBy(*key).orderBy(F.desc("seq"))
    level = F.coalesce(F.lag("level").over(inside), F.col("__level"))
    out = rows.join(after, key).withColumns({"has_children": F.coalesce(level > F.col("level"), F.lit(False)), "next_page": F.coalesce(later(opens, inside), F.col("__page"))})
    return out.drop("__block", "__level", "__page")


def demote(text: Column) -> Column:
    """Headings one level down, outside fences that stand at the start of a line."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("o"))

    def step(a: Column, line: Column) -> Column:
        fence = line.rlike(r"^(```|~~~)")
        out = F.when(~a["code"] & ~fence & line.rlike(r"^#{1,5}[ \t]"), F.concat(F.lit("#"), line)).otherwise(line)
        return F.struct(F.when(fence, ~a["code"]).otherwise(a["code"]).alias("code"), F.concat(a["o"], F.array(out)).alias("o"))

    return F.array_join(F.aggregate(lines, start, step, lambda a: a["o"]), "\n")


def assemble(articles: DataFrame, by: list[str], break_: str = "\n\n\\newpage\n\n") -> DataFrame:
    """One text for each group: articles (index, title, body) in order under second-level titles, bodies demoted."""
    part = F.struct("index", F.concat(F.lit("## "), "title", F.lit("\n\n"), demote(F.col("body"))).alias("text"))
    return articles.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), break_).alias("markdown"), F.count("*").alias("articles"))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, gap): missing or unexpected."""
    missing = expected.select(key).join(found.select(key), key, "left_anti").withColumn("gap", F.lit("missing"))
    return missing.unionByName(found.select(key).join(expected.select(key), key, "left_anti").withColumn("gap", F.lit("unexpected")))


def numeric_prefix(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d+)", 1).try_cast("long")


def document_files(files: DataFrame, name: str, variant: str = "") -> DataFrame:
    """Markdown files of one variant ('' or e.g. '_translated'), by numeric prefix, then name."""
    other = F.col(name).rlike(r"_(translated|annotated)\.md$")
    wanted = F.col(name).endswith(f"{variant}.md") & (~other if not variant else F.lit(True))
    return files.where(wanted).withColumn("position", numeric_prefix(F.col(name)))

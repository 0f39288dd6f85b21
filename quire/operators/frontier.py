"""URL frontiers: ordered lists of URLs with sections, made unique in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import url as U
from quire.storage import Scratch


def from_list(df: DataFrame, urls: str = "urls", title: str = "Custom Selection") -> DataFrame:
    """A flat list (an array column) as one section."""
    rows = df.select(F.posexplode(urls).alias("raw_index", "url"))
    return rows.select(F.col("raw_index").cast("long"), "url", F.lit(0).alias("section_index"), F.lit(title).alias("title"), F.col("raw_index").alias("order_in_section"))


def from_sections(df: DataFrame, sections: str = "sections") -> DataFrame:
    """Grouped lists (array<struct<title, entryUrl, urls>>), in order."""
    outer = df.select(F.posexplode(sections).alias("section_index", "s"))
    rows = outer.select("section_index", F.col("s.title").alias("title"), F.posexplode("s.urls").alias("order_in_section", "url"))
    return rows.withColumn("raw_index", F.col("section_index").cast("long") * (1 << 32) + F.col("order_in_section"))


def from_rows(rows: DataFrame, order: str) -> DataFrame:
    """Lists held as rows (section_index, title, url, order): the rows of ``from_list`` and ``from_sections``, without an
    array that holds a whole list."""
    numbered = dense_index(rows.withColumn("__o", F.struct("section_index", order)), "__o", "__at")
    first = numbered.groupBy("section_index").agg(F.min("__at").alias("__first"))
    out = numbered.join(first, "section_index").withColumn("order_in_section", F.col("__at") - F.col("__first"))
    return out.select((F.col("section_index").cast("long") * (1 << 32) + F.col("order_in_section")).alias("raw_index"), "url", "section_index", "title", "order_in_section")


def entry_points(root: Column, more: Column) -> Column:
    """Root first, trimmed, without repeats and blanks, in order."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(root), more), lambda x: F.trim(x)), lambda x: x != ""))


def select(raw: DataFrame, domains: list[str], base: str = "", ignored: list[str] | None = None) -> DataFrame:
    """URLs in scope and not ignored, with their normal form and its hash."""
    rows = raw.where(U.in_scope(F.col("url"), domains, base) & ~U.is_ignored(F.col("url"), ignored or []))
    return rows.withColumns({"normal": U.normalize(F.col("url")), "hash8": U.hash8(F.col("url"))})


def unique(rows: DataFrame, key: str = "normal", order: str = "raw_index") -> DataFrame:
    """The first row of each key in order of arrival; a pre-aggregated minimum, so a much-repeated key is one row a task."""
    value = F.struct(order, *[c for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.min_by(value, F.col(order)).alias("__v")).select(key, "__v.*")


def dense_index(rows: DataFrame, order: str = "raw_index", name: str = "final_index") -> DataFrame:
    """0, 1, ... by ``order``, without one task for all rows.

    One exchange deals the rows to sorted ranges, as many as their size asks for; each row gets its range and its place
    there. They are written before the ranges are counted: a second run of the exchange would cut other ranges.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__row", F.monotonically_increasing_id())
    ranged = Scratch(rows.sparkSession).put(ranged, "ranged").withColumn("__range", F.shiftright("__row", 33))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__size"))  # a row for each range
    before = counts.select("__range", F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = ranged.join(F.broadcast(before), "__range")
    return out.withColumn(name, F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).drop("__range", "__row", "__before")


def last_section(raw: DataFrame) -> DataFrame:
    """(url, section_index): by raw URL, the last writer wins."""
    return raw.groupBy("url").agg(F.max_by("section_index", "raw_index").alias("section_index"))


def section_pages(frontier: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row a section, its pages in order: array<struct<order, final_index, index, url>>."""
    joined = frontier.drop("section_index").join(mapping, "url")
    page = F.struct(F.col("order_in_section").alias("order"), "final_index", F.col("final_index").cast("string").alias("index"), "url")
    return joined.groupBy("section_index").agg(F.array_sort(F.collect_list(page)).alias("pages"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Later spellings of a URL that stand in another section than the kept one."""
    first = rows.groupBy("normal").agg(F.min_by(F.struct("url", "section_index"), "raw_index").alias("kept"))
    joined = rows.join(first, "normal")
    return joined.where("url <> kept.url and section_index <> kept.section_index").select("raw_index", "url", "section_index", F.col("kept.url").alias("kept_url"), F.col("kept.section_index").alias("kept_section"))


def stats(raw: DataFrame, selected: DataFrame) -> DataFrame:
    """raw, unique, duplicates (distinct repeated spellings), ignored (what is left of raw), dropped (rows that went)."""
    first = selected.groupBy("normal").agg(F.min("raw_index").alias("raw_index"))
    again = selected.join(first, ["normal", "raw_index"], "left_anti")
    a = raw.agg(F.count("*").alias("raw"), F.countDistinct("section_index").alias("sections"))
    b = first.agg(F.count("*").alias("uniq"))
    c = again.agg(F.countDistinct("url").alias("duplicates"))
    rows = a.join(b).join(c)  # one row each
    return rows.select("raw", F.col("uniq").alias("unique"), "duplicates", (F.col("raw") - F.col("uniq") - F.col("duplicates")).alias("ignored"), (F.col("raw") - F.col("uniq")).alias("dropped"), "sections")


def without_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Drop links that are other entry points, compared without query, fragment and trailing slash."""
    keyed = rows.withColumn("__k", U.comparable(F.col("url")))
    return keyed.join(entries.select(U.comparable(F.col("url")).alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def follow(pages: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """Pagination: (url, depth) from ``start`` along ``next_url``, ending at none, the same URL, a seen one, or the limit."""
    level = start.select("url").withColumns({"start": F.col("url"), "depth": F.lit(0)})
    out = level
    for depth in range(1, most):
        step = level.join(pages.select("url", "next_url"), "url").where("next_url is not null and next_url <> url")
        step = step.select(F.col("next_url").alias("url"), "start", F.lit(depth).alias("depth"))
        level = step.join(out.select("start", "url"), ["start", "url"], "left_anti").select("url", "start", "depth")
        out = out.unionByName(level)
    return out

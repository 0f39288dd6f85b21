"""Queries on URLs and frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import url as U
from quire.operators import frontier
from quire.plans.registry import query, table

P = r"'(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
DOMAINS, IGNORED = ["example.com", "example.org"], ["/de/", "ads-track"]


def cut(url: str, n: int) -> str:
    return f"regexp_extract({url}, {P}, {n})"


def sql_host(url: str) -> str:
    return f"regexp_replace(regexp_replace(lower({cut(url, 2)}), '^.*@', ''), ':\\d*$', '')"


def sql_normal(url: str) -> str:
    pairs = f"list_filter(string_split(regexp_replace({cut(url, 4)}, '^\\?', ''), '&'), lambda p: p <> '')"
    named = f"list_transform({pairs}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
    return (
        f"CASE WHEN regexp_matches({url}, '(?s)^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+') THEN lower({cut(url, 1)}) || '://' || "
        f"CASE lower({cut(url, 1)}) WHEN 'http' THEN regexp_replace(lower({cut(url, 2)}), ':80$', '') WHEN 'https' THEN regexp_replace(lower({cut(url, 2)}), ':443$', '') ELSE lower({cut(url, 2)}) END || "
        f"CASE WHEN {cut(url, 3)} IN ('', '/') THEN '/' ELSE regexp_replace({cut(url, 3)}, '/$', '') END || "
        f"CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string(list_transform(list_sort(list_transform({named}, lambda p, i: {{k: split_part(p, '=', 1), i: i, p: p}})), lambda x: x.p), '&') ELSE '' END ELSE {url} END"
    )


def sql_scope(url: str) -> str:
    below = " OR ".join(f"{sql_host(url)} = '{d}' OR ends_with({sql_host(url)}, '.{d}')" for d in DOMAINS)
    return f"lower({cut(url, 1)}) IN ('http', 'https') AND ({below})"


def sql_ignored(url: str) -> str:
    return "(" + " OR ".join(f"contains({url}, '{s}')" for s in IGNORED) + ")"


#: Pages twice, the second time in another spelling and section: repeats as a crawl meets them.
RAW_SQL = f"""raw AS (SELECT page_id AS raw_index, url, {sql_host('url')} AS section FROM pages
UNION ALL SELECT 1000000 + page_id, CASE WHEN page_id % 2 = 0 THEN url || '#again' ELSE url END,
CASE WHEN page_id % 3 = 0 THEN 'other' ELSE {sql_host('url')} END FROM pages),
sectioned AS (SELECT *, dense_rank() OVER (ORDER BY section) - 1 AS section_index FROM raw),
selected AS (SELECT *, {sql_normal('url')} AS normal FROM sectioned WHERE {sql_scope('url')} AND NOT {sql_ignored('url')}),
uniq AS (SELECT normal, min(raw_index) AS raw_index, arg_min(url, raw_index) AS url FROM selected GROUP BY normal),
frontier AS (SELECT *, row_number() OVER (ORDER BY raw_index) - 1 AS final_index FROM uniq)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("raw_index"), "url", U.host(F.col("url")).alias("section"))
    again = pages.select(
        (F.col("raw_index") + 1000000).alias("raw_index"),
        F.when(F.col("raw_index") % 2 == 0, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("raw_index") % 3 == 0, "other").otherwise(F.col("section")).alias("section"),
    )
    rows = pages.unionByName(again)
    names = frontier.dense_index(rows.select("section").distinct(), "section", "section_index")
    return rows.join(names, "section")


@query(f"SELECT page_id, {sql_normal('url')} AS normal, substr(md5({sql_normal('url')}), 1, 8) AS hash8 FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U2, O9."""
    return table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("normal"), U.hash8(F.col("url")).alias("hash8"))


@query(f"WITH {RAW_SQL} SELECT final_index, raw_index, url, normal, substr(md5(normal), 1, 8) AS hash8 FROM frontier")
def url_frontier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U4, U5, F4, W1, W2, SO1: scope and ignore rules, first spelling wins, dense index by arrival."""
    rows = frontier.select(raw(spark, sf_dir).drop("section", "section_index"), DOMAINS, "", IGNORED)
    return frontier.dense_index(frontier.unique(rows)).select("final_index", "raw_index", "url", "normal", "hash8")


@query(
    f"""WITH {RAW_SQL}, again AS (SELECT s.url FROM selected s ANTI JOIN uniq u ON s.normal = u.normal AND s.raw_index = u.raw_index)
SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM uniq) AS unique, (SELECT count(DISTINCT url) FROM again) AS duplicates,
(SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) - (SELECT count(DISTINCT url) FROM again) AS ignored,
(SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) AS dropped, (SELECT count(DISTINCT section_index) FROM sectioned) AS sections"""
)
def url_frontier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    rows = raw(spark, sf_dir)
    return frontier.stats(rows, frontier.select(rows, DOMAINS, "", IGNORED))


@query(
    f"""WITH {RAW_SQL}, mapped AS (SELECT url, arg_max(section_index, raw_index) AS section_index FROM sectioned GROUP BY url)
SELECT m.section_index, final_index, final_index::VARCHAR AS page_index, url FROM frontier JOIN mapped m USING (url)"""
)
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each section; a URL of two sections lands in the later one."""
    rows = raw(spark, sf_dir)
    front = frontier.dense_index(frontier.unique(frontier.select(rows, DOMAINS, "", IGNORED)))
    pages = frontier.section_pages(front.withColumn("order_in_section", F.col("raw_index")), frontier.last_section(rows))
    return pages.select("section_index", F.explode("pages").alias("p")).select("section_index", "p.final_index", F.col("p.index").alias("page_index"), "p.url")


@query(
    f"""WITH {RAW_SQL}, mapped AS (SELECT url, arg_max(section_index, raw_index) AS section_index FROM sectioned GROUP BY url)
SELECT m.section_index, count(*) AS pages, arg_min(url, final_index) AS first_url, arg_max(url, final_index) AS last_url FROM frontier JOIN mapped m USING (url) GROUP BY ALL"""
)
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3, F5."""
    rows = raw(spark, sf_dir)
    front = frontier.dense_index(frontier.unique(frontier.select(rows, DOMAINS, "", IGNORED))).drop("section_index")
    joined = front.join(frontier.last_section(rows), "url")
    return joined.groupBy("section_index").agg(F.count("*").alias("pages"), F.min_by("url", "final_index").alias("first_url"), F.max_by("url", "final_index").alias("last_url"))


@query(
    f"""WITH {RAW_SQL}, kept AS (SELECT normal, arg_min(url, raw_index) AS kept_url, arg_min(section_index, raw_index) AS kept_section FROM selected GROUP BY normal)
SELECT raw_index, url, section_index, kept_url, kept_section FROM selected JOIN kept USING (normal) WHERE url <> kept_url AND section_index <> kept_section"""
)
def section_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, O5."""
    return frontier.conflicts(frontier.select(raw(spark, sf_dir), DOMAINS, "", IGNORED))


@query(f"SELECT page_id, coalesce({sql_host('url')} IN ('m.casino-win.example.com'), false) AS exact, {sql_scope('url')} AND starts_with(url, 'https://') AS in_scope, {sql_ignored('url')} AS ignored FROM pages")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, U4, U5."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.exact_host(u, ["m.casino-win.example.com"]).alias("exact"), (U.in_scope(u, DOMAINS) & u.startswith("https://")).alias("in_scope"), U.is_ignored(u, IGNORED).alias("ignored"))


@query("SELECT page_id, url FROM pages WHERE regexp_replace(regexp_replace(url, '(?s)[?#].*$', ''), '/$', '') NOT IN (SELECT regexp_replace(regexp_replace(url, '(?s)[?#].*$', ''), '/$', '') FROM pages WHERE page_id % 7 = 0)")
def entry_point_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6, F2, SRC6."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return frontier.without_entries(pages, pages.where("page_id % 7 = 0"))


@query(
    f"""SELECT page_id, CASE WHEN {sql_host('url')} <> '' THEN {sql_host('url')} || '-docs' ELSE 'misc-docs' END AS directory,
CASE WHEN page_id < 1000 THEN lpad(page_id::VARCHAR, 3, '0') ELSE page_id::VARCHAR END || '-' || regexp_replace(list_filter(string_split(url, '/'), lambda s: s <> '')[-1], '[^a-zA-Z0-9\\-_]', '-', 'g') || '.pdf' AS indexed,
substr(md5({sql_normal('url')}), 1, 8) || '-' || regexp_replace(list_filter(string_split(url, '/'), lambda s: s <> '')[-1], '[^a-zA-Z0-9\\-_]', '-', 'g') || '.pdf' AS hashed FROM pages"""
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U9, U10, U11."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.output_directory(u).alias("directory"), U.output_name(u, F.col("page_id")).alias("indexed"), U.output_name(u, hashed=True).alias("hashed"))


@query(
    """WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '007-' || page_id || '.pdf' WHEN 1 THEN substr(md5(url), 1, 8) || '-a-b.pdf' WHEN 2 THEN 'plain.pdf' ELSE '1234-x.pdf' END AS f FROM pages),
s AS (SELECT page_id, regexp_replace(f, '\\.pdf$', '') AS stem FROM n)
SELECT page_id, CASE WHEN contains(stem, '-') THEN split_part(stem, '-', 1) END AS prefix, CASE WHEN contains(stem, '-') THEN regexp_extract(stem, '^[^-]*-(.*)$', 1) ELSE stem END AS original_name,
contains(stem, '-') AND regexp_matches(split_part(stem, '-', 1), '^\\d{3}$') AS is_numeric_index, contains(stem, '-') AND regexp_matches(split_part(stem, '-', 1), '^[a-f0-9]{8}$') AS is_hash,
CASE WHEN contains(stem, '-') AND regexp_matches(split_part(stem, '-', 1), '^\\d{3}$') THEN split_part(stem, '-', 1)::INT END AS index FROM s"""
)
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U12."""
    k = F.col("page_id") % 4
    name = F.when(k == 0, F.concat(F.lit("007-"), "page_id", F.lit(".pdf"))).when(k == 1, F.concat(F.substring(F.md5("url"), 1, 8), F.lit("-a-b.pdf"))).when(k == 2, "plain.pdf").otherwise("1234-x.pdf")
    return table(spark, sf_dir, "pages").select("page_id", U.parse_name(name).alias("n")).select("page_id", "n.*")


@query(
    f"""SELECT page_id, {cut('url', 1)} || '://' || {cut('url', 2)} || regexp_replace({cut('url', 3)}, '/$', '') || '.md' || {cut('url', 4)} AS source_url,
CASE WHEN len(string_split({sql_host('url')}, '.')) > 2 THEN {sql_host('url')} || ',' || array_to_string(string_split({sql_host('url')}, '.')[-2:], '.') ELSE {sql_host('url')} END AS domains,
replace({sql_host('url')}, '.', '_') AS slug FROM pages"""
)
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U13, U14, U15, SRC7."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.with_suffix(u).alias("source_url"), F.array_join(U.domains(u), ",").alias("domains"), U.slug(u).alias("slug"))


@query(
    """WITH a AS (SELECT page_id, (page_id * 37) % 256 AS p, (page_id * 11) % 256 AS q FROM pages)
SELECT page_id, p || '.' || q || '.3.4' AS address, p IN (0, 10, 127) OR p >= 224 OR (p = 169 AND q = 254) OR (p = 172 AND q BETWEEN 16 AND 31) OR (p = 192 AND q = 168) OR (p = 100 AND q BETWEEN 64 AND 127) AS private FROM a"""
)
def private_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U17."""
    pages = table(spark, sf_dir, "pages")
    address = F.concat_ws(".", (F.col("page_id") * 37 % 256).cast("string"), (F.col("page_id") * 11 % 256).cast("string"), F.lit("3"), F.lit("4"))
    return pages.select("page_id", address.alias("address"), U.is_private(address).alias("private"))


@query(
    """WITH i AS (SELECT page_id, ['https://a.example/x.png?v=1', 'https://a.example/y.WEBP', '/logo-icon.svg', 'https://b.example/icon-small.gif', 'data:image'][1 + page_id % 5] AS u, ['', 'image/webp', 'image/svg+xml; q=1'][1 + page_id % 3] AS t, ['', 'JPEG'][1 + page_id % 2] AS f FROM pages)
SELECT page_id, CASE WHEN f = 'JPEG' THEN '.jpg' WHEN contains(t, 'webp') THEN '.webp' WHEN contains(t, 'svg') THEN '.svg' WHEN u LIKE '%x.png%' THEN '.png' WHEN u LIKE '%WEBP' THEN '.WEBP' WHEN u LIKE 'https%gif' THEN '.gif' ELSE '.img' END AS extension,
CASE WHEN f = 'JPEG' THEN false WHEN t <> '' THEN true ELSE u IN ('https://a.example/y.WEBP', 'https://b.example/icon-small.gif') END AS convert, u = 'https://b.example/icon-small.gif' AS icon, starts_with(u, 'https://') AS remote FROM i"""
)
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U18, U20, U21, F14."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    u = pick(["https://a.example/x.png?v=1", "https://a.example/y.WEBP", "/logo-icon.svg", "https://b.example/icon-small.gif", "data:image"], 5)
    t, f = pick(["", "image/webp", "image/svg+xml; q=1"], 3), pick(["", "JPEG"], 2)
    rows = table(spark, sf_dir, "pages").select("page_id", u.alias("u"), t.alias("t"), f.alias("f"))
    u, t, f = F.col("u"), F.col("t"), F.col("f")
    return rows.select("page_id", U.image_extension(u, t, f).alias("extension"), U.needs_conversion(u, t, f).alias("convert"), U.is_icon(u).alias("icon"), U.is_remote(u).alias("remote"))


@query(
    """WITH p AS (SELECT page_id, '/srv/books' AS root, ['/srv/books', '/srv/books/a/b', '/srv/books-old/a', '/srv/books/../etc', '/srv/./books/x'][1 + page_id % 5] AS t FROM pages)
SELECT page_id, t IN ('/srv/books', '/srv/books/a/b', '/srv/./books/x') AS inside, contains(url, 'doubleclick.net') OR page_id % 2 = 0 AS blocked FROM p JOIN pages USING (page_id)"""
)
def path_and_request_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U19, U22, V14."""
    target = F.element_at(F.array(*map(F.lit, ["/srv/books", "/srv/books/a/b", "/srv/books-old/a", "/srv/books/../etc", "/srv/./books/x"])), (F.col("page_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("page_id") % 2 == 0, "media").otherwise("script")
    return table(spark, sf_dir, "pages").select("page_id", U.is_inside(F.lit("/srv/books"), target).alias("inside"), U.is_blocked(F.col("url"), kind).alias("blocked"))


@query(
    f"""SELECT page_id, {cut('url', 1)} || '://' || {cut('url', 2)} || '/a/c?x=1' AS rooted, CASE WHEN {cut('url', 3)} LIKE '%/' THEN NULL ELSE {cut('url', 1)} || '://' || {cut('url', 2)} || '/img.png' END AS up,
{cut('url', 1)} || '://cdn.example/x.js' AS other, 'mailto:x@y' AS scheme, {cut('url', 1)} || '://' || {cut('url', 2)} || '/s.png 1x, b.png 2x' AS srcset FROM pages"""
)
def resource_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U7, U8."""
    u = F.col("url")
    up = F.when(~U.part(u, 3).endswith("/"), U.resolve(F.lit("../img.png"), u))
    return table(spark, sf_dir, "pages").select("page_id", U.resolve(F.lit("/a/./b/../c?x=1"), u).alias("rooted"), up.alias("up"), U.resolve(F.lit("//cdn.example/x.js"), u).alias("other"), U.resolve(F.lit("mailto:x@y"), u).alias("scheme"), U.resolve_srcset(F.lit("/s.png 1x , b.png 2x"), u).alias("srcset"))


@query("""WITH f AS (SELECT page_id, ['docs.example.com-api', 'guides', 'my.site', 'plain-notes'][1 + page_id % 4] AS d FROM pages) SELECT page_id, CASE d WHEN 'docs.example.com-api' THEN 'Example-Api' WHEN 'guides' THEN 'Guides' WHEN 'my.site' THEN 'My-Site' ELSE 'Notes' END || '_20260101.pdf' AS name FROM f""")
def friendly_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16, M9."""
    d = F.element_at(F.array(*map(F.lit, ["docs.example.com-api", "guides", "my.site", "plain-notes"])), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", U.friendly_name(d, "20260101", {}).alias("name"))

"""Queries on titles, HTML and Markdown texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import url as U
from quire.plans.registry import query, table

TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"
STRIP = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<noscript\\b.*?</noscript\\s*>|<style\\b.*?</style\\s*>|<template\\b.*?</template\\s*>', '', 'g')"
HREF = f"regexp_extract_all(regexp_replace({STRIP}, '(?s)<!--.*?-->', '', 'g'), '(?is)<a\\b[^>]*?\\shref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT2."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


def sql_clean(title: str) -> str:
    """The rule over the separators, written out."""
    firsts = " ".join(f"WHEN contains({title}, '{s}') AND length(trim(split_part({title}, '{s}', 1))) >= 2 THEN trim(split_part({title}, '{s}', 1))" for s in T.SEPARATORS)
    return f"CASE {firsts} ELSE trim({title}) END"


RAW_TITLE = "CASE page_id % 9 WHEN 7 THEN {t} WHEN 8 THEN 'x' || {s1} || {t} || ' / ' || {h} ELSE {t} || {s} || {h} || ' | ' || page_id END"


@query(
    f"""WITH t AS (SELECT page_id, {TITLE} AS title, regexp_extract(url, '://([^/?#]*)', 1) AS host, {T.SEPARATORS} AS s FROM pages),
r AS (SELECT page_id, {RAW_TITLE.format(t='title', s1='s[2]', s='s[1 + page_id % 7]', h='host')} AS raw FROM t) SELECT page_id, {sql_clean('raw')} AS title FROM r"""
)
def page_title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD26: titles of all pages, each with a separator, its host and its number; some first parts are too short."""
    title, k = T.html_title(F.col("html")), F.col("page_id")
    sep = F.element_at(F.array(*map(F.lit, T.SEPARATORS)), (k % 7 + 1).cast("int"))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    raw = F.when(k % 9 == 7, title).when(k % 9 == 8, F.concat(F.lit("x" + T.SEPARATORS[1]), title, F.lit(" / "), host)).otherwise(F.concat(title, sep, host, F.lit(" | "), k.cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", T.clean_title(raw).alias("title"))


@query(f"SELECT page_id, md5({STRIP}) AS stripped FROM pages")
def strip_nontext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT4."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_nontext(F.col("html"))).alias("stripped"))


@query(
    f"""WITH l AS (SELECT page_id, url, unnest({HREF}) AS href, unnest(range(len({HREF}))) AS n FROM pages)
SELECT page_id, n::INT AS n, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE href END AS link FROM l
WHERE NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')"""
)
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT3, SRC3, F1: links of pages against their URL."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(T.hrefs(F.col("html"))).alias("n", "href"))
    rows = rows.where(~F.col("href").startswith("#") & ~F.col("href").startswith("javascript:"))
    return rows.select("page_id", "n", U.resolve(F.col("href"), F.col("url")).alias("link"))


@query(f"SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, sum(len({HREF}))::BIGINT AS links, count(*) AS pages FROM pages GROUP BY ALL")
def links_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT3."""
    rows = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), F.size(T.hrefs(F.col("html"))).alias("n"))
    return rows.groupBy("host").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


@query(
    f"""WITH t AS (SELECT page_id, {TITLE} AS title, url FROM pages)
SELECT page_id, '---' || chr(10) || CASE WHEN title <> '' THEN 'title: ' || title || chr(10) ELSE '' END || 'source: ' || url || chr(10) || '---' || chr(10) || chr(10) || 'body' AS markdown,
CASE WHEN title <> '' THEN title END AS title, url AS source, 'body' AS body, CASE WHEN title = '' THEN NULL WHEN regexp_full_match(title, '\\d+(\\.\\d+)?') THEN 'number' ELSE 'string' END AS kind FROM t"""
)
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD21, SRC16, M12: add, parse, remove."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.nullif(T.html_title(F.col("html")), F.lit("")).alias("t"))
    rows = rows.withColumn("markdown", T.add_frontmatter(F.lit("body"), [("title", F.col("t")), ("source", F.col("url"))]))
    rows = rows.withColumn("m", T.frontmatter(F.col("markdown")))
    return rows.select("page_id", "markdown", F.col("m")["title"].alias("title"), F.col("m")["source"].alias("source"), T.without_frontmatter(F.col("markdown")).alias("body"), T.value_kind(F.col("m")["title"]).alias("kind"))


HEADED = "CASE doc_id % 5 WHEN 0 THEN '# ' || first || chr(10) || chr(10) || text WHEN 1 THEN text || chr(10) || '## ' || first || '  ' WHEN 2 THEN text WHEN 3 THEN '### ' || first || chr(10) || text ELSE chr(10) || '# ' || first || ' more' || chr(10) || text END"


@query(
    f"""WITH d AS (SELECT doc_id, text, string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1] AS first FROM documents), m AS (SELECT doc_id, first, {HEADED} AS m FROM d),
h AS (SELECT *, regexp_extract(m, '^\\s*#{{1,6}}[ \\t]+([^\\n]*)', 1) AS head FROM m)
SELECT doc_id, CASE WHEN regexp_matches(m, '(?m)^##?[ \\t]+\\S') THEN trim(regexp_extract(m, '(?m)^##?[ \\t]+(\\S[^\\n]*)$', 1)) END AS title,
md5(CASE WHEN head <> '' AND lower(regexp_replace(head, '\\s+', '', 'g')) = lower(regexp_replace(first, '\\s+', '', 'g')) THEN regexp_replace(m, '^\\s*#{{1,6}}[ \\t]+[^\\n]*\\n*', '') ELSE m END) AS body FROM h"""
)
def markdown_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD22, MD23: whole texts under headings that say their first line, or more, or at their end."""
    first = F.split(F.btrim("text", F.lit(" \t\n\r")), "\n")[0]
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", first.alias("first"))
    feed, k = F.lit("\n"), F.col("doc_id") % 5
    m = (
        F.when(k == 0, F.concat(F.lit("# "), "first", F.lit("\n\n"), "text"))
        .when(k == 1, F.concat("text", F.lit("\n## "), "first", F.lit("  ")))
        .when(k == 2, F.col("text"))
        .when(k == 3, F.concat(F.lit("### "), "first", feed, "text"))
        .otherwise(F.concat(F.lit("\n# "), "first", F.lit(" more\n"), "text"))
    )
    rows = rows.withColumn("m", m)
    return rows.select("doc_id", T.title_from(F.col("m")).alias("title"), F.md5(T.without_leading_title(F.col("m"), F.col("first"))).alias("body"))


LONGEST = "coalesce(list_max(list_transform(regexp_extract_all({c}, '`+'), lambda x: length(x))), 0)"
TICKED = "CASE doc_id % 3 WHEN 0 THEN line WHEN 1 THEN replace(line, 'e', '`') ELSE '``' || replace(line, 'an', '`````') END"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), c AS (SELECT doc_id, n, {TICKED} AS c FROM l),
b AS (SELECT *, trim(regexp_replace(c, '\\s+', ' ', 'g')) AS body FROM c), f AS (SELECT *, repeat('`', {LONGEST.format(c='body')} + 1) AS fence, CASE WHEN starts_with(body, '`') OR ends_with(body, '`') THEN ' ' ELSE '' END AS pad FROM b)
SELECT doc_id, n::INT AS n, CASE WHEN body = '' THEN '' ELSE fence || pad || body || pad || fence END AS code, {LONGEST.format(c='c')}::INT AS longest FROM f"""
)
def inline_code_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT7, A19: every line of every text as a code span, with backticks in it."""
    line, k = F.col("line"), F.col("doc_id") % 3
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    c = F.when(k == 0, line).when(k == 1, F.replace(line, F.lit("e"), F.lit("`"))).otherwise(F.concat(F.lit("``"), F.replace(line, F.lit("an"), F.lit("`````"))))
    return rows.select("doc_id", "n", T.inline_code(c).alias("code"), T.longest_backticks(c).alias("longest"))


@query(
    """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, '> **Note:**' || chr(10) || '>' || chr(10) || array_to_string(list_transform(l, lambda x: '> ' || trim(x)), chr(10)) AS quote FROM l"""
)
def callout_blockquote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD6."""
    body = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(T.SEPARATOR_SPACES)) != ""), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", T.callout(body, "Note").alias("quote"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), w AS (SELECT doc_id, n, line, regexp_extract_all(line, '[^ ]+') AS w FROM l WHERE trim(line) <> '')
SELECT doc_id, n::INT AS n, '|' || array_to_string(list_transform(w, lambda x, i: CASE WHEN i % 2 = 0 THEN ':' ELSE '' END || repeat('-', greatest(10, least(50, 3 * length(x)))::INT) || CASE WHEN i % 3 = 0 THEN ':' ELSE '' END), '|') || '|' AS separator,
(n % 4)::INT AS indent FROM w"""
)
def table_separator_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD11, MD13, A20: a separator row from every line of every text, a cell for each word and three dashes a letter."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where(F.trim("line") != "")
    words = F.filter(F.split("line", " ", -1), lambda w: w != "")
    cell = lambda x, i: F.concat(F.when((i + 1) % 2 == 0, " :").otherwise(" "), F.repeat(F.lit("-"), 3 * F.length(x)), F.when((i + 1) % 3 == 0, ": ").otherwise(" "))
    row = F.concat(F.lit("|"), F.array_join(F.transform(words, cell), "|"), F.lit("|"))
    text = F.concat(F.repeat(F.lit(" "), (F.col("n") % 4 + 1).cast("int")), F.lit("x\n\n"), F.repeat(F.lit(" "), (F.col("n") % 4).cast("int")), F.lit("y"))
    return rows.select("doc_id", "n", T.clamp_separator(row).alias("separator"), T.common_indent(text).alias("indent"))


@query(
    """WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\\s\\[\\]()*_!]+') AS w FROM documents), i AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
p AS (SELECT doc_id, w, i, CASE WHEN i % 5 = 4 THEN w ELSE '![' || lower(w[1]) || '](u)' END AS p FROM i), k AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p)
SELECT d.doc_id, md5(coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (p IS DISTINCT FROM before OR i % 5 = 4), '')) AS images FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""
)
def adjacent_image_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, MD4: every word of every text as a paragraph, most of them images."""
    words = F.regexp_extract_all("text", F.lit(r"([^\s\[\]()*_!]+)"), F.lit(1))
    part = lambda w, i: F.when(i % 5 == 4, w).otherwise(F.concat(F.lit("!["), F.lower(F.substring(w, 1, 1)), F.lit("](u)")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.drop_repeated_images(F.array_join(F.transform(words, part), "\n\n"))).alias("images"))


CAPTION = "lower(regexp_replace({x}, '[\\s*_.]+', '', 'g'))"


@query(
    f"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '[\\[\\]()*_!]', '', 'g') AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), s AS (SELECT * FROM l WHERE trim(line) <> ''),
c AS (SELECT *, trim(CASE WHEN n % 2 = 0 THEN translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE line || '!' END) AS said FROM s),
t AS (SELECT doc_id, n, '![' || line || '](u)' || chr(10) || CASE WHEN {CAPTION.format(x='said')} = {CAPTION.format(x='line')} AND line <> '' THEN chr(10) ELSE chr(10) || '*' || said || '*' || chr(10) END || 'end' AS t FROM c)
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY n)) AS captions FROM t GROUP BY doc_id"""
)
def caption_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10, MD2: every line of every text as an image, and in italics under it in capitals, or with one more sign."""
    bare = F.transform(F.split("text", "\n", -1), lambda x, n: F.struct(F.regexp_replace(x, r"[\[\]()*_!]", "").alias("line"), n.alias("n")))
    lines = F.filter(bare, lambda x: F.trim(x["line"]) != "")

    def block(x):  # noqa: ANN001, ANN202
        said = F.trim(F.when(x["n"] % 2 == 0, F.translate(x["line"], "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.concat(x["line"], F.lit("!"))))
        return F.concat(F.lit("!["), x["line"], F.lit("](u)\n\n*"), said, F.lit("*\nend"))

    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, block).alias("b")).where(F.size("b") > 0)
    return rows.select("doc_id", F.md5(T.drop_repeated_captions(F.array_join("b", "\n"))).alias("captions"))


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)*')) >= 3 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 8
AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.7 * length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS eligible FROM documents"""
)
def eligible_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    return table(spark, sf_dir, "documents").select("doc_id", T.eligible_english(F.col("text")).alias("eligible"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
SELECT doc_id, 'segment-' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY i)::VARCHAR, 4, '0') AS segment_id, line AS text, NOT regexp_full_match(trim(line), '[\\d\\s\\pP]*') AND length(trim(line)) >= 2 AS translatable FROM s WHERE trim(line) <> ''""")
def paragraph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13, F6, F9."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).where(F.trim("text") != "")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return rows.select("doc_id", F.concat(F.lit("segment-"), U.padded(n, 4)).alias("segment_id"), "text", T.translatable(F.col("text")).alias("translatable"))


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, text, 1 + doc_id % 3 AS n FROM documents), w AS (
SELECT doc_id, text, n, 0 AS k, 1::BIGINT AS pos, 0::BIGINT AS found FROM d
UNION ALL SELECT doc_id, text, n, k + 1, pos + strpos(substr(text, pos), 'th') + 1, pos + strpos(substr(text, pos), 'th') - 1 FROM w WHERE k < n AND strpos(substr(text, pos), 'th') > 0)
SELECT d.doc_id, max(CASE WHEN w.k = d.n THEN found END)::INT AS place FROM d JOIN w USING (doc_id) GROUP BY d.doc_id"""
)
def nth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15."""
    return table(spark, sf_dir, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("th"), (F.col("doc_id") % 3 + 1).cast("int")).cast("int").alias("place"))


@query(
    """WITH r AS (SELECT doc_id, unnest([0, 3, 5, 20, 24, 40]) + doc_id % 4 * unnest([0, 1, 0, 2, 0, 1]) AS s, unnest([4, 6, 9, 25, 26, 41]) AS e FROM documents),
v AS (SELECT doc_id, s, greatest(s, e) AS e FROM r), f AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM f)
SELECT doc_id, min(s)::INT AS start, max(e)::INT AS "end", bool_or(s < 8 AND e > 4) AS overlaps FROM g GROUP BY doc_id, g"""
)
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16, O8, J10."""
    k = (F.col("doc_id") % 4).cast("int")
    pairs = [(0, 0, 4), (3, 1, 6), (5, 0, 9), (20, 2, 25), (24, 0, 26), (40, 1, 41)]
    kind = "array<struct<start:int,end:int>>"
    ranges = F.array(*[F.struct((F.lit(s) + k * m).cast("int").alias("start"), F.greatest(F.lit(s) + k * m, F.lit(e)).cast("int").alias("end")) for s, m, e in pairs]).cast(kind)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.merge_ranges(ranges)).alias("r"))
    one = F.array(F.struct(F.col("r.start").alias("start"), F.col("r.end").alias("end")))
    return rows.select("doc_id", "r.start", "r.end", T.overlaps(one, F.lit(4), F.lit(8)).alias("overlaps"))


@query(
    """WITH c AS (SELECT doc_id, doc_id % 256 AS r, doc_id * 7 % 256 AS g, doc_id * 13 % 256 AS b FROM documents)
SELECT doc_id, (r + g + b) / 3.0 < 128 AS dark, CASE WHEN r < 50 AND g < 50 AND b < 50 THEN 'white' END AS background, CASE WHEN r > 200 AND g > 200 AND b > 200 THEN 'black' END AS ink,
'p{margin:' || r || 'mm}' AS css FROM c"""
)
def print_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT14, HT15, HT18."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 256).alias("r"), (F.col("doc_id") * 7 % 256).alias("g"), (F.col("doc_id") * 13 % 256).alias("b"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    css = F.replace(T.fill(F.lit("p{margin:{{m}}}"), {"m": "@mm"}), F.lit("@"), r.cast("string"))
    return rows.select("doc_id", T.dark(r, g, b).alias("dark"), T.print_colours(r, g, b, "background").alias("background"), T.print_colours(r, g, b, "ink").alias("ink"), css.alias("css"))


@query(
    """WITH c AS (SELECT doc_id, ['a|b', 'short', '/usr/local/share', 'someLongCamelName', 'plainlowercaseword', 'Some Long Words'][1 + doc_id % 6] AS c FROM documents)
SELECT doc_id, c IN ('a|b', '/usr/local/share', 'someLongCamelName') AS breaks, '漢*x*字' AS emphasis, doc_id % 6 = 0 AS pipe_table FROM c"""
)
def inline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, MD27, F8."""
    c = F.element_at(F.array(*map(F.lit, ["a|b", "short", "/usr/local/share", "someLongCamelName", "plainlowercaseword", "Some Long Words"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.needs_breaks(c).alias("breaks"), T.cjk_emphasis(F.lit("漢_x_字")).alias("emphasis"), T.is_pipe_table(F.concat(c, F.lit("\n"), c)).alias("pipe_table"))

"""Queries on run state, batches, books, checks and small computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import misc as M
from quire.functions import text as T
from quire.functions import url as U
from quire.operators import batching, book, frontier, state, verify
from quire.plans.registry import query, table
from quire.plans.texts import TITLE
from quire.plans.urls import sql_host
from quire.session import ship

STATUS = ["success", "failed", "retrying", "skipped", "processing"]
STATUS_SQL = "['success', 'failed', 'retrying', 'skipped', 'processing'][1 + (event_id % 5)]"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of URLs: users stand for URLs."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("url"), F.col("event_id").alias("event_seq"), status.alias("status"))


LATEST = f"latest AS (SELECT user_id AS url, arg_max({STATUS_SQL}, event_id) AS status, max(event_id) AS last_seq, count(*) FILTER ({STATUS_SQL} = 'retrying') AS retries, count(*) AS events FROM events GROUP BY user_id)"


@query(f"WITH {LATEST} SELECT * FROM latest")
def url_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W19, W20, ST7, D10."""
    return state.latest(events(spark, sf_dir), "url")


STATS = f"""WITH {LATEST}, s AS (SELECT count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
count(*) FILTER (status IN ('success', 'failed', 'skipped')) AS processed, sum(retries)::BIGINT AS retried FROM latest), t AS (SELECT *, greatest(total - processed, 0) AS pending, round(processed / total * 100, 2) AS percentage FROM s)"""


@query(f"{STATS} SELECT * FROM t")
def progress_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5, A16, M7."""
    return state.progress(state.latest(events(spark, sf_dir), "url"))


@query(f"{STATS} SELECT *, 120 AS elapsed, round(processed / 120.0::DOUBLE, 6) AS rate, CASE WHEN total > processed AND processed > 0 THEN round((total - processed) / (processed / 120.0::DOUBLE)) ELSE 0 END AS eta_s FROM t")
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A7, A11."""
    return state.rates(state.progress(state.latest(events(spark, sf_dir), "url")).withColumn("elapsed", F.lit(120)), "elapsed")


@query(f"SELECT DISTINCT user_id AS url FROM events WHERE {STATUS_SQL} = 'success' AND user_id NOT IN (SELECT user_id FROM events WHERE {STATUS_SQL} = 'failed')")
def state_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, SO5."""
    e = events(spark, sf_dir)
    return state.repaired(e.where("status = 'success'").select("url").distinct(), e.where("status = 'failed'"), "url")


@query(f"""WITH {LATEST}, again AS (SELECT url FROM latest WHERE status = 'failed') SELECT url, CASE WHEN url IN (SELECT url FROM again) THEN CASE WHEN url % 2 = 0 THEN 'success' ELSE 'failed' END ELSE status END AS status FROM latest""")
def retry_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST4: failed ones run once more, and the results replace theirs."""
    latest = state.latest(events(spark, sf_dir), "url").select("url", "status")
    again = latest.where("status = 'failed'").select("url", F.when(F.col("url") % 2 == 0, "success").otherwise("failed").alias("status"))
    return latest.where("status <> 'failed' or status is null").unionByName(again)


DOCS = "d AS (SELECT doc_id, text, source, length(text) AS n, 1 + length(text) // 1500 AS page_count FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of books: source is the book, hundreds of ids its sections."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("index"), F.col("source").alias("book"), F.floor(F.col("doc_id") / 100).cast("string").alias("section"), F.concat(F.lit("t"), "doc_id").alias("title"), (F.lit(1) + F.floor(F.length("text") / 1500)).alias("page_count"))


BOOK = f"""{DOCS}, p AS (SELECT doc_id AS index, source AS book, (doc_id // 100)::VARCHAR AS section, 't' || doc_id AS title, page_count, coalesce(sum(page_count) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS start_page FROM d),
h AS (SELECT book, min(index) AS index, 1 AS level, section AS title, min(start_page) AS page FROM p GROUP BY book, section),
o AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY index, level) AS seq, level, title, page FROM (SELECT * FROM h UNION ALL SELECT book, index, 2, title, start_page FROM p))"""


@query(f"WITH {BOOK} SELECT * FROM p")
def toc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, J3, J4."""
    return book.start_pages(files(spark, sf_dir))


@query(f"WITH {BOOK} SELECT * FROM o")
def toc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, D23."""
    return book.outline(book.start_pages(files(spark, sf_dir)))


@query(f"WITH {BOOK} SELECT *, coalesce(lead(level) OVER w > level, false) AS has_children, lead(page) OVER w AS next_page FROM o WINDOW w AS (PARTITION BY book ORDER BY seq)")
def outline_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, W7."""
    return book.ranges(book.outline(book.start_pages(files(spark, sf_dir))))


@query(f"WITH {BOOK} SELECT book, level, count(*) AS entries FROM o GROUP BY ALL")
def toc_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return book.outline(book.start_pages(files(spark, sf_dir))).groupBy("book", "level").agg(F.count("*").alias("entries"))


@query("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, string_agg('## ' || page_id || chr(10) || chr(10) || '## Head' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || url, chr(10) || chr(10) || '\\newpage' || chr(10) || chr(10) ORDER BY page_id) AS markdown, count(*) AS articles FROM pages GROUP BY 1""")
def assembly_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD33, MD25 (plain fences), SNK5."""
    from quire.functions import url as U

    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("index"), F.col("page_id").cast("string").alias("title"), U.host(F.col("url")).alias("host"), F.concat(F.lit("# Head\n```\n# code\n```\n"), "url").alias("body"))
    return book.assemble(rows, ["host"])


@query("""WITH e AS (SELECT page_id::VARCHAR AS k FROM pages WHERE page_id % 10 <> 3), f AS (SELECT page_id::VARCHAR AS k FROM pages WHERE page_id % 7 <> 2)
SELECT k AS title, 'missing' AS gap FROM e WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT k, 'unexpected' FROM f WHERE k NOT IN (SELECT k FROM e)""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, J13, SO3, V12."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("title"))
    return book.coverage(p.where("page_id % 10 <> 3"), p.where("page_id % 7 <> 2"), "title")


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id || '-a.md' WHEN 1 THEN doc_id || '-a_translated.md' WHEN 2 THEN 'readme' || doc_id || '.md' ELSE doc_id || '.txt' END AS f FROM documents)
SELECT doc_id, f AS name, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS position FROM n WHERE doc_id % 4 IN (0, 2)""")
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, SRC11, SRC14, O1."""
    k, s = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(s, F.lit("-a.md"))).when(k == 1, F.concat(s, F.lit("-a_translated.md"))).when(k == 2, F.concat(F.lit("readme"), s, F.lit(".md"))).otherwise(F.concat(s, F.lit(".txt")))
    return book.document_files(table(spark, sf_dir, "documents").select("doc_id", name.alias("name")), "name")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
SELECT doc_id, i::BIGINT AS i, (i - 1) // 5 AS batch FROM l""")
def batches_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return batching.fixed(rows.select("doc_id", (F.col("p") + 1).cast("long").alias("i")), "doc_id", "i", 5)


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
w AS (SELECT doc_id, i, 0 AS b, 1 AS n, length(line) AS c FROM l WHERE i = 1
UNION ALL SELECT l.doc_id, l.i, CASE WHEN n >= 12 OR c + length(line) > 6000 THEN b + 1 ELSE b END, CASE WHEN n >= 12 OR c + length(line) > 6000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 12 OR c + length(line) > 6000 THEN length(line) ELSE c + length(line) END
FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id, i::INT AS i, b::INT AS batch FROM w""")
def batches_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12, MD30: batches of at most 12 segments and 6000 characters."""
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(batching.greedy(sizes)).alias("p", "batch"))
    return rows.select("doc_id", (F.col("p") + 1).cast("int").alias("i"), "batch")


KEY = "md5('provider' || ':' || '' || ':' || 'm1' || ':' || lang || ':' || 'page' || ':' || text)"


@query(f"SELECT doc_id, {KEY} AS translation_key, sha256('markdown:' || source) AS resource_key, substr(sha256(source), 1, 24) AS image_key, sha256(text) AS checksum FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and hashing keys."""
    key = M.translation_key(F.lit("provider"), F.lit(None).cast("string"), F.lit("m1"), F.col("lang"), F.lit("page"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("translation_key"), M.digest_key(F.lit("markdown"), F.col("source")).alias("resource_key"), F.substring(F.sha2("source", 256), 1, 24).alias("image_key"), F.sha2("text", 256).alias("checksum"))


CACHE = "c AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE doc_id % 3 = 0)"


@query(f"WITH {CACHE} SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT k FROM c)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, J14."""
    d = table(spark, sf_dir, "documents").withColumn("k", F.md5("text"))
    return batching.look_up(d, d.where("doc_id % 3 = 0").select("k").distinct(), "k")[1].select("doc_id")


@query(f"WITH {CACHE} SELECT lang, count(*) AS segments, count(*) FILTER (md5(text) IN (SELECT k FROM c)) AS hits, round(count(*) FILTER (md5(text) IN (SELECT k FROM c)) / count(*), 6) AS ratio FROM documents GROUP BY lang")
def cache_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, J8."""
    d = table(spark, sf_dir, "documents").withColumn("k", F.md5("text"))
    cache = d.where("doc_id % 3 = 0").select("k").distinct().withColumn("hit", F.lit(True))
    return d.join(cache, "k", "left").groupBy("lang").agg(F.count("*").alias("segments"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 6).alias("ratio"))


@query("""SELECT conv_id, turn, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) AS rank FROM conversations) WHERE rank <= 3""")
def review_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3."""
    return batching.top(table(spark, sf_dir, "conversations"), "conv_id", F.col("role") == "assistant", "turn", 3).select("conv_id", "turn", "role", "rank")


@query("""WITH r AS (SELECT doc_id, n_chars, doc_id % 8 AS k, doc_id % 97 / 97.0::DOUBLE AS u, least(2000 * power(2, doc_id % 8), 60000)::DOUBLE AS base FROM documents)
SELECT doc_id, k AS attempt, round(least(CASE doc_id % 4 WHEN 0 THEN base WHEN 1 THEN base * u WHEN 2 THEN base / 2 + base * u / 2 ELSE base + u * (n_chars * 3 - base) END, 60000)) AS delay,
CASE WHEN k = 0 THEN 1500.0 WHEN k = 1 THEN NULL WHEN n_chars % 40 <= 30 THEN n_chars % 40 * 1000.0 END::DOUBLE AS retry_after FROM r""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3: every kind of jitter with draws from the rows; waits from the documents' sizes, those above 30 s refused."""
    k, u = F.col("doc_id") % 8, F.col("doc_id") % 97 / F.lit(97.0)
    value = F.when(k == 0, "1.5").when(k == 1, "99").otherwise((F.col("n_chars") % 40).cast("string"))
    base, cap = M.backoff(k, F.lit(2000.0), F.lit(60000.0)), F.lit(60000.0)
    delay = F.lit(None).cast("double")
    for n, kind in enumerate(("none", "full", "equal", "decorrelated")):
        delay = F.when(F.col("doc_id") % 4 == n, M.jittered(base, F.col("n_chars").cast("double"), cap, kind, draw=u)).otherwise(delay)
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("attempt"), delay.alias("delay"), M.retry_after_ms(value, F.current_timestamp()).alias("retry_after"))


MESSAGES = ["HTTP 404 timeout", "net::ERR_NETWORK_CHANGED", "HTTP 403", "Target closed", "HTTP 503", "ENOSPC: disk", "Invalid selector x", "ResizeObserver loop limit exceeded", "odd"]
CLASSES = ["retryable_timeout", "retryable_network", "permanent_http", "retryable_browser", "retryable_network", "system_error", "permanent_validation", "ignorable_js", "unknown"]


@query(f"""WITH m AS (SELECT doc_id, {CLASSES}[1 + doc_id % 9] AS c, {MESSAGES}[1 + doc_id % 9] AS message FROM documents)
SELECT doc_id, c AS category, starts_with(c, 'retryable') AS retryable, CASE c WHEN 'retryable_network' THEN 5.0 WHEN 'retryable_timeout' THEN 3.0 WHEN 'retryable_browser' THEN 3.0 ELSE 1.0 END::DOUBLE AS attempts,
CASE c WHEN 'retryable_network' THEN 2000.0 WHEN 'retryable_timeout' THEN 5000.0 WHEN 'retryable_browser' THEN 10000.0 ELSE 0.0 END::DOUBLE AS delay_ms, c = 'ignorable_js' AS harmless, NOT regexp_matches(message, 'HTTP 4') AS navigation FROM m""")
def error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, M2, F10, F11, F12."""
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("doc_id") % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", message.alias("message"), M.error_category(message).alias("category"))
    s = M.retry_strategy(F.col("category"))
    return rows.select("doc_id", "category", M.is_retryable(F.col("category")).alias("retryable"), s["attempts"].alias("attempts"), s["delay_ms"].alias("delay_ms"), M.holds_any(F.col("message"), M.HARMLESS).alias("harmless"), M.retryable_navigation(F.lit(None).cast("string"), F.col("message")).alias("navigation"))


@query("""WITH u AS (SELECT doc_id, 1 + doc_id % 40 AS v, ['mm', 'cm', 'in', 'pt', 'px'][1 + doc_id % 5] AS u FROM documents)
SELECT doc_id, round(v * CASE u WHEN 'mm' THEN 72 / 25.4 WHEN 'cm' THEN 72 / 2.54 WHEN 'in' THEN 72.0 WHEN 'pt' THEN 1.0 ELSE 0.75 END, 6)::DOUBLE AS points, round(210 * 72 / 25.4, 6)::DOUBLE AS width,
CASE WHEN v * 97 < 60 THEN v * 97 || 's' WHEN v * 97 < 3600 THEN (v * 97 // 60) || 'm' || (v * 97 % 60) || 's' ELSE (v * 97 // 3600) || 'h' || (v * 97 // 60 % 60) || 'm' END AS took FROM u""")
def length_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M5, M6, M8."""
    v, unit = F.col("doc_id") % 40 + 1, F.element_at(F.array(*map(F.lit, ["mm", "cm", "in", "pt", "px"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(M.points(F.concat(v.cast("string"), unit)), 6).alias("points"), F.round(M.page_points(F.lit("a4"), 0), 6).alias("width"), M.duration(v * 97).alias("took"))


@query("""SELECT doc_id, ['png', 'jpg', 'gif', 'webp', 'pdf', 'avif', 'svg', NULL][1 + doc_id % 8] AS format FROM documents""")
def image_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17."""
    heads = ["89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "52494646AABBCCDD57454250", "255044462D312E", "00000020667479706176696600", "3C3F786D6C3E0A3C73766720", "0011"]
    data = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", M.image_format(data).alias("format"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN NULL ELSE '{"b": {"c": 2}}' END AS object, doc_id % 100 AS done, 100 AS total, 'difficult"x"' AS compacted, doc_id % 2 = 0 AS found, true AS font FROM documents""")
def output_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13, M16, M18, M19."""
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, 'noise {"a": 1} end').when(k == 1, "{broken").otherwise('```json\n{"b": {"c": 2}}\n```')
    line = M.progress_line(F.concat(F.lit("Progress: "), (F.col("doc_id") % 100).cast("string"), F.lit("/100 files processed")))
    actual = F.when(F.col("doc_id") % 2 == 0, "so dif-\nficult").otherwise("easy")
    return table(spark, sf_dir, "documents").select("doc_id", M.json_object(raw).alias("object"), line["done"].cast("long").alias("done"), line["total"].alias("total"), M.compacted(F.lit("diﬃcult “x”")).alias("compacted"), M.contains_text(F.lit("difficult"), actual).alias("found"), M.fonts_match(F.lit("Noto Serif"), F.lit("ABCDEF+NotoSerif-Bold")).alias("font"))


@query("""WITH RECURSIVE d AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
w AS (SELECT source, k, round(n_chars::DOUBLE) AS mean FROM d WHERE k = 1 UNION ALL SELECT d.source, d.k, round((w.mean * w.k + d.n_chars) / d.k) FROM w JOIN d ON d.source = w.source AND d.k = w.k + 1)
SELECT source AS "group", arg_max(mean, k) AS mean, max(k) AS n FROM w GROUP BY source""")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean rounded after each value, in order of doc_id."""
    ship(spark)
    return M.running_means(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, max(len(string_split(line, '|'))) AS columns FROM l GROUP BY doc_id""")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the widest row, lines as rows."""
    return table(spark, sf_dir, "documents").select("doc_id", M.column_count(F.transform(F.split("text", "\n", -1), lambda x: F.split(x, r"\|", -1))).cast("long").alias("columns"))


@query("""WITH m AS (SELECT doc_id, doc_id::VARCHAR AS index, CASE WHEN doc_id % 50 = 7 THEN 'u0' ELSE 'u' || doc_id END AS url, CASE WHEN doc_id % 40 = 1 THEN 'bad' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 30 <> 5),
p AS (SELECT doc_id::VARCHAR AS index, 'u' || doc_id AS url, sha256(text) AS sha FROM documents WHERE doc_id % 33 <> 4), j AS (SELECT m.index AS mi, p.index AS pi, m.url AS mu, p.url AS pu, m.sha AS ms, p.sha AS ps FROM m FULL JOIN p ON m.index = p.index)
SELECT 'unmapped' AS rule, mi AS index FROM j WHERE pi IS NULL UNION ALL SELECT 'missing', pi FROM j WHERE mi IS NULL UNION ALL SELECT 'url', mi FROM j WHERE mu <> pu UNION ALL SELECT 'checksum', mi FROM j WHERE ms <> ps
UNION ALL SELECT 'repeated_url', min(index) FROM m GROUP BY url HAVING count(*) > 1 UNION ALL SELECT 'repeated_index', min(index) FROM m GROUP BY index HAVING count(*) > 1""")
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, V11, SO2, SO4, O2, D9."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("index"), F.concat(F.lit("u"), "doc_id").alias("url"), F.sha2("text", 256).alias("sha256"))
    manifest = d.where("doc_id % 30 <> 5").withColumns({"url": F.when(F.col("doc_id") % 50 == 7, "u0").otherwise(F.col("url")), "sha256": F.when(F.col("doc_id") % 40 == 1, "bad").otherwise(F.col("sha256"))})
    return state.manifest_violations(manifest.drop("doc_id"), d.where("doc_id % 33 <> 4").drop("doc_id"))


@query("""WITH a AS (SELECT doc_id, sha256(text) AS s FROM documents), f AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE s END AS s FROM a WHERE doc_id % 11 <> 0)
SELECT 'u' || a.doc_id AS url, 'p' || a.doc_id AS path, coalesce(a.s = f.s, false) AS resumable, CASE WHEN f.s IS NULL THEN 'missing' WHEN f.s <> a.s THEN 'changed' END AS problem FROM a LEFT JOIN f USING (doc_id)""")
def resume_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, V13, ST3."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), F.concat(F.lit("p"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    found = a.where("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("sha256")))
    return state.resumable(a.drop("doc_id"), found.select("path", "sha256"))


@query("""WITH RECURSIVE n AS (SELECT page_id AS url, CASE WHEN page_id % 6 < 5 THEN page_id + 1 END AS next FROM pages), w AS (SELECT page_id AS start, page_id AS url, 0 AS depth FROM pages WHERE page_id % 6 = 0
UNION ALL SELECT start, next, depth + 1 FROM w JOIN n USING (url) WHERE next IS NOT NULL AND depth < 3) SELECT start, url, depth FROM w""")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4, SRC5: four pages at most."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("url"), F.when(F.col("page_id") % 6 < 5, F.col("page_id") + 1).alias("next_url"))
    return frontier.follow(p, p.where("url % 6 = 0"), 4).select("start", "url", "depth")


@query("""SELECT 0 AS section_index, 'Custom Selection' AS title, count(*) AS urls, min(url) AS first_url FROM pages WHERE page_id < 50 UNION ALL SELECT 1 + page_id % 3, 'part' || page_id % 3, count(*), min(url) FROM pages WHERE page_id < 60 GROUP BY page_id % 3""")
def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC2, A3: a flat list and grouped lists of URLs, as arrays of a setting's size; ``url_list_rows`` takes all pages."""
    pages = table(spark, sf_dir, "pages")
    flat = frontier.from_list(pages.where("page_id < 50").agg(F.collect_list("url").alias("urls")))
    parts = pages.where("page_id < 60").groupBy((F.col("page_id") % 3).alias("k")).agg(F.collect_list("url").alias("urls"))
    one = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "urls"))), lambda x: F.struct(F.concat(F.lit("part"), x["k"].cast("string")).alias("title"), F.lit("").alias("entryUrl"), x["urls"].alias("urls"))).alias("sections"))
    grouped = frontier.from_sections(one).withColumn("section_index", F.col("section_index") + 1)
    rows = flat.select("section_index", "title", "url").unionByName(grouped.select("section_index", "title", "url"))
    return rows.groupBy("section_index", "title").agg(F.count("*").alias("urls"), F.min("url").alias("first_url"))


@query("""WITH l AS (SELECT 0 AS section_index, 'Custom Selection' AS title, page_id, url FROM pages UNION ALL SELECT (1 + page_id % 3)::INT, 'part' || page_id % 3, page_id, url FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY section_index ORDER BY page_id) - 1 AS order_in_section FROM l)
SELECT section_index * 4294967296::BIGINT + order_in_section AS raw_index, url, section_index, title, order_in_section FROM n""")
def url_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC2, A3: a flat list and grouped lists of all pages, as rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    k = (F.col("page_id") % 3).cast("int")
    flat = pages.select("*", F.lit(0).alias("section_index"), F.lit("Custom Selection").alias("title"))
    grouped = pages.select("*", (k + 1).alias("section_index"), F.concat(F.lit("part"), k.cast("string")).alias("title"))
    return frontier.from_rows(flat.unionByName(grouped), "page_id")


@query("""WITH p AS (SELECT page_id + 1 AS page, CASE WHEN page_id % 9 = 1 THEN 420.0 ELSE 360.0 END AS width, 576.0 AS height, CASE page_id % 13 WHEN 2 THEN 'x' || chr(65533) WHEN 3 THEN ' ' ELSE 't' || page_id END AS text, page_id % 17 = 4 AS m FROM pages)
SELECT 'page_size' AS kind, page::BIGINT AS page, '420.0x576.0' AS detail FROM p WHERE width > 361 UNION ALL SELECT 'replacement_character', page, '' FROM p WHERE contains(text, chr(65533)) UNION ALL SELECT 'missing_glyph', page, '1' FROM p WHERE m UNION ALL SELECT 'empty_page', page, '' FROM p WHERE text = ' '
UNION ALL SELECT 'overflow', page, 'wide' FROM p WHERE page % 5 = 0 UNION ALL SELECT 'invalid_link', page, '99999999' FROM p WHERE page % 6 = 0 UNION ALL SELECT 'bookmark_title', page, 'other' FROM p WHERE page % 8 = 0 UNION ALL SELECT 'toc_page_number', page, 'x' FROM p WHERE page % 14 = 0 AND page % 6 <> 0""")
def verify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: pages, boxes, links, bookmarks and printed numbers; a link without a target has no number to compare."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select((k + 1).alias("page"), F.when(k % 9 == 1, 420.0).otherwise(360.0).alias("width"), F.lit(576.0).alias("height"), (k + 1).cast("string").alias("label"), F.when(k % 13 == 2, "x�").when(k % 13 == 3, " ").otherwise(F.concat(F.lit("t"), k.cast("string"))).alias("text"), (k % 17 == 4).cast("int").alias("missing_glyphs"), F.lit(0).alias("images"))
    box = lambda text, x1: pages.select("page", F.lit("text").alias("kind"), F.lit(text).alias("text"), F.lit(60.0).alias("x0"), F.lit(x1).alias("x1"), F.lit(100.0).alias("y0"), F.lit(112.0).alias("y1"))
    spans = box("fine", 200.0).unionByName(box("wide", 500.0).where("page % 5 = 0"))
    links = pages.select("page", F.when(F.col("page") % 6 == 0, F.lit(99999999)).otherwise(F.col("page")).cast("long").alias("target"), F.when(F.col("page") % 14 == 0, "x").otherwise(F.col("label")).alias("printed"))
    entries = pages.select("page", F.when(F.col("page") % 8 == 0, "other").otherwise(F.regexp_replace("text", "^t", "t")).alias("title"), F.lit(False).alias("has_children"))
    parts = [verify.page_issues(pages, 360.0, 576.0), verify.overflow(spans, pages, 36.0, 36.0, 36.0, 36.0), verify.link_issues(links, pages), verify.bookmark_issues(entries, pages), verify.toc_number_issues(links, pages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"""WITH p AS (SELECT page_id, {TITLE} AS title, {sql_host('url')} AS host FROM pages),
e AS (SELECT title, count(*) AS n FROM (SELECT title FROM p WHERE page_id % 7 <> 3 UNION ALL SELECT title FROM p WHERE page_id % 11 = 5) GROUP BY title),
g AS (SELECT DISTINCT host FROM p), f AS (SELECT DISTINCT host FROM p WHERE page_id % 3 <> 1)
SELECT 'article_bookmark' AS kind, t.title AS detail FROM (SELECT DISTINCT title FROM p) t LEFT JOIN e ON t.title = e.title WHERE coalesce(n, 0) <> 1
UNION ALL SELECT 'missing_group', host FROM g WHERE host NOT IN (SELECT host FROM f) UNION ALL SELECT 'missing_font', 'Other Sans'"""
)
def verify_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' titles and hosts against an outline that lacks some and has some twice; two required fonts."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), U.host(F.col("url")).alias("host"))
    articles = pages.where("page_id % 7 <> 3").select("title").unionByName(pages.where("page_id % 11 = 5").select("title")).withColumn("level", F.lit(2))
    groups = pages.where("page_id % 3 <> 1").select(F.col("host").alias("title")).distinct()
    fonts = spark.createDataFrame([("Noto Serif",), ("Other Sans",)], "font string")
    used = pages.select(F.when(F.col("page_id") % 2 == 0, "ABCDEF+NotoSerif").otherwise("NotoSerif-Bold").alias("used")).distinct()
    rows = verify.article_issues(pages.select("title").distinct(), articles)
    rows = rows.unionByName(verify.missing(pages.select(F.col("host").alias("title")).distinct(), groups, "title", "missing_group"))
    return rows.unionByName(verify.font_issues(fonts, used)).select("kind", "detail")


@query("""WITH i AS (SELECT page_id AS page FROM pages WHERE page_id % 20 = 0) SELECT count(*) AS issues, count(*) = 0 AS passed, array_to_string(list_sort(list(page))[:12], ',') AS preview FROM i""")
def verify_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, D24."""
    rows = table(spark, sf_dir, "pages").where("page_id % 20 = 0").select(F.lit("x").alias("kind"), F.col("page_id").alias("page"), F.lit("").alias("detail"))
    return verify.verdict(rows).select("issues", "passed", F.array_join(F.transform("preview_pages", lambda x: x.cast("string")), ",").alias("preview"))


@query("""SELECT count(*) AS issues, count(*) = 0 AS passed, array_to_string(list_sort(list(page_id))[:12], ',') AS preview FROM pages""")
def verify_verdict_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page has an issue."""
    rows = table(spark, sf_dir, "pages").select(F.lit("x").alias("kind"), F.col("page_id").alias("page"), F.lit("").alias("detail"))
    return verify.verdict(rows).select("issues", "passed", F.array_join(F.transform("preview_pages", lambda x: x.cast("string")), ",").alias("preview"))


@query("""SELECT doc_id AS id, unnest(list_filter([CASE WHEN doc_id % 200 + 100 >= 200 THEN 'no_body_width' END, CASE WHEN doc_id % 7 = 0 THEN 'header_zone' END], lambda x: x IS NOT NULL)) AS rule FROM documents""")
def layout_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7."""
    d = table(spark, sf_dir, "documents")
    return verify.layout_issues(d.select(F.col("doc_id").alias("id"), F.lit(200).alias("width"), F.lit(300).alias("height"), (F.col("doc_id") % 200).alias("left"), F.lit(100).alias("right"), F.lit(30).alias("top"), F.lit(30).alias("bottom"), F.when(F.col("doc_id") % 7 == 0, 40).otherwise(10).alias("header"), F.lit(10).alias("footer")))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'credentials' WHEN 1 THEN 'domain' WHEN 2 THEN 'address' WHEN 3 THEN 'size' WHEN 4 THEN 'type' END AS refused FROM pages""")
def resource_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10, SRC9."""
    k = F.col("page_id") % 6
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "https://a:b@x.org/").when(k == 1, "https://y.org/").otherwise("https://x.org/p").alias("url"), F.when(k == 2, "10.0.0.1").otherwise("93.184.216.34").alias("address"), F.when(k == 3, 10**8).otherwise(10).alias("bytes"), F.when(k == 4, "image/png").otherwise("text/html").alias("content_type"))
    return verify.response_guards(rows, ["x.org"], 5 << 20).select("page_id", "refused")


@query("""SELECT doc_id AS id, ['quote', 'occurrence', 'explanation', 'example', 'prompt'][1 + doc_id % 6] AS rule FROM documents WHERE doc_id % 6 < 5""")
def annotation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 but for the type; ``annotation_responses`` has that, V1, V2, V4 and V5."""
    k = F.col("doc_id") % 6
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(k == 0, "").otherwise("a phrase").alias("quote"), F.when(k == 1, 0).otherwise(1).alias("occurrence"), F.when(k == 2, "plain").otherwise("说明").alias("explanation"), F.when(k == 3, "two words").otherwise("This is fine.").alias("example"), F.when(k == 4, "no han").otherwise("").alias("prompt"))
    return verify.annotation_issues(rows)


@query("""SELECT count(*) AS requests, sum(length(html))::BIGINT AS bytes, count(*) FILTER (page_id % 3 = 0) AS revalidated FROM pages""")
def resource_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, bytes, revalidations."""
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("requests"), F.sum(F.length("html")).alias("bytes"), F.count_if(F.col("page_id") % 3 == 0).alias("revalidated"))


@query("""WITH us AS (SELECT 'w' || k AS word, '/u' || k || '/' AS ipa FROM range(0, 50) t(k)), uk AS (SELECT 'w' || k AS word, '/k' || k || '/' AS ipa FROM range(25, 80) t(k))
SELECT doc_id, us.ipa AS us, uk.ipa AS uk FROM documents LEFT JOIN us ON us.word = 'w' || (doc_id % 100) LEFT JOIN uk ON uk.word = 'w' || (doc_id % 100)""")
def ipa_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, J7."""
    entry = lambda a, b, p: spark.range(a, b).select(F.concat(F.lit("w"), "id").alias("word"), F.concat(F.lit(f"/{p}"), "id", F.lit("/")).alias("us" if p == "u" else "uk"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("w"), (F.col("doc_id") % 100).cast("string")).alias("word"))
    return d.join(entry(0, 50, "u"), "word", "left").join(entry(25, 80, "k"), "word", "left").select("doc_id", "us", "uk")

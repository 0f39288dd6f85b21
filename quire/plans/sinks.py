"""Queries that write and read again, and small rules over runs."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import ipa
from quire.operators import state
from quire.plans.registry import query, table
from quire.plans.runs import LATEST, STATS, events
from quire.session import ship
from quire.storage import shared_dir
from quire.sources import files


def folder(spark: SparkSession) -> str:
    """A new folder that all can reach: in the checkpoint folder if there is one."""
    return f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"


@query(f"{STATS} SELECT total, succeeded, failed, skipped, processed, pending, percentage FROM t")
def state_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK7, SNK8, SNK10: a report as JSON, read back with its schema."""
    path = folder(spark)
    report = state.progress(state.latest(events(spark, sf_dir), "url")).drop("retried")
    files.write_report(report, path)
    return files.read_json(spark, path, "total long, succeeded long, failed long, skipped long, processed long, pending long, percentage double", True)


@query(f"""WITH {LATEST} SELECT 2 AS version, url, CASE WHEN status IN ('success', 'failed') THEN status END AS state, CASE WHEN status = 'success' THEN sha256(url::VARCHAR) END AS sha256 FROM latest""")
def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3, SNK6, SRC12, D8: the state of a run, sidecar first, a JSON line for each URL, so no task holds all of it."""
    path = folder(spark)
    latest = state.latest(events(spark, sf_dir), "url").withColumn("u", F.col("url").cast("string"))
    latest.where("status = 'failed'").select("url", F.lit("x").alias("error")).write.json(f"{path}/failures")
    rows = latest.select(F.lit(2).alias("version"), "url", F.when(F.col("status").isin("success", "failed"), F.col("status")).alias("state"), F.when(F.col("status") == "success", F.sha2("u", 256)).alias("sha256"))
    rows.write.json(f"{path}/progress")
    failed = files.read_json(spark, f"{path}/failures", "url long, error string")
    read = files.read_json(spark, f"{path}/progress", "version int, url long, state string, sha256 string", True)
    return read.join(failed, "url", "left").select("version", "url", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("state")).alias("state"), "sha256")


@query("""WITH o AS (SELECT page_id % 40 AS url, page_id % 3 AS index FROM pages WHERE page_id < 120), n AS (SELECT page_id % 50 AS url, page_id % 4 AS index FROM pages)
SELECT url, index, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT DISTINCT * FROM n WHERE (url, index) NOT IN (SELECT url, index FROM o)) GROUP BY ALL""")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4, SNK11: rows are added to a log unless it has their key."""
    p = table(spark, sf_dir, "pages")
    old = p.where("page_id < 120").select((F.col("page_id") % 40).alias("url"), (F.col("page_id") % 3).alias("index"))
    new = p.select((F.col("page_id") % 50).alias("url"), (F.col("page_id") % 4).alias("index"))
    return files.merge_log(old, new, ["url", "index"]).groupBy("url", "index").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT url, page_id % 3 AS index FROM pages), n AS (SELECT url, page_id % 4 AS index FROM pages)
SELECT url, index, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT DISTINCT * FROM n WHERE (url, index) NOT IN (SELECT url, index FROM o)) GROUP BY ALL""")
def failure_log_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4, SNK11: old log and new rows hold all pages."""
    p = table(spark, sf_dir, "pages")
    old, new = (p.select("url", (F.col("page_id") % k).alias("index")) for k in (3, 4))
    return files.merge_log(old, new, ["url", "index"]).groupBy("url", "index").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'source' AS variant, md5(text) AS md FROM documents UNION ALL SELECT doc_id, 'translated', md5('T' || text) FROM documents WHERE doc_id % 2 = 0")
def markdown_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, SNK5: documents by variant, the source always."""
    path = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = d.withColumn("variant", F.lit("source")).unionByName(d.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("T"), "text").alias("text"), F.lit("translated").alias("variant")))
    files.write_variants(rows, path)
    return spark.read.schema("doc_id long, text string, variant string").parquet(path).select("doc_id", "variant", F.md5("text").alias("md"))


@query("SELECT doc_id, 'source' AS variant, md5(text) AS md FROM documents UNION ALL SELECT doc_id, 'translated', md5('T' || text) FROM documents")
def markdown_variants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, SNK5: every document in both variants."""
    path = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = d.withColumn("variant", F.lit("source")).unionByName(d.select("doc_id", F.concat(F.lit("T"), "text").alias("text"), F.lit("translated").alias("variant")))
    files.write_variants(rows, path)
    return spark.read.schema("doc_id long, text string, variant string").parquet(path).select("doc_id", "variant", F.md5("text").alias("md"))


@query("""WITH c AS (SELECT doc_id, ['page.width', 'fonts.body', 'toc.depth', 'page.margin.left'][1 + doc_id % 4] AS path FROM documents) SELECT doc_id, path FROM c WHERE path LIKE 'page.%' OR path LIKE 'fonts.%'""")
def layout_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: settings that a layout controls and another layer sets too."""
    path = F.element_at(F.array(*map(F.lit, ["page.width", "fonts.body", "toc.depth", "page.margin.left"])), (F.col("doc_id") % 4 + 1).cast("int"))
    controlled = spark.createDataFrame([("page",), ("fonts",)], "top string")
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).join(controlled, F.substring_index("path", ".", 1) == F.col("top"), "left_semi")


@query("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS total, count(*) FILTER (page_id % 3 = 0) AS loaded, count(*) FILTER (page_id % 3 = 1) AS failed, count(*) FILTER (page_id % 3 = 2) AS pending, count(*) FILTER (page_id % 3 = 0) = count(*) AS all_loaded FROM pages GROUP BY 1""")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    from quire.functions import url as U

    rows = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), (F.col("page_id") % 3).alias("k"))
    n = lambda k: F.count_if(F.col("k") == k)
    return rows.groupBy("host").agg(F.count("*").alias("total"), n(0).alias("loaded"), n(1).alias("failed"), n(2).alias("pending"), (n(0) == F.count("*")).alias("all_loaded"))


@query("""WITH w AS (SELECT user_id, event_id // 100 AS slot, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, slot, n, greatest(n - 5, 0) AS over_cap FROM w""")
def rate_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: requests of a host in each interval, and those above the cap of five."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("slot")).agg(F.count("*").alias("n"))
    return rows.withColumn("over_cap", F.greatest(F.col("n") - 5, F.lit(0)))


@query("""WITH c AS (SELECT user_id, event_id, event_id // 7 % 2 AS v FROM events), l AS (SELECT *, v = lag(v, 1) OVER w AND v = lag(v, 2) OVER w AS same FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, min(event_id) FILTER (same) AS stable_at FROM l GROUP BY user_id""")
def stable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8: the first of three equal counts in a row."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor(F.col("event_id") / 7) % 2).alias("v"))
    same = (F.col("v") == F.lag("v", 1).over(w)) & (F.col("v") == F.lag("v", 2).over(w))
    return rows.withColumn("same", same).groupBy("user_id").agg(F.min(F.when(F.col("same"), F.col("event_id"))).alias("stable_at"))


@query("""SELECT doc_id, '{"a":"' || source || '","b":"' || lang || '"}' AS json FROM documents""")
def canonical_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps as JSON with their keys in order."""
    m = F.create_map(F.lit("b"), F.col("lang"), F.lit("a"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))).alias("json"))


def sql_us(x: str) -> str:
    for pattern, sign in ipa.US_SIGNS:
        x = f"regexp_replace({x}, '{pattern}', '{sign}', 'g')"
    return x


def sql_uk(x: str) -> str:
    """Of texts without stress marks."""
    for sign, other in ipa.UK_SIGNS.items():
        x = f"replace({x}, '{sign}', '{other}')"
    return x


PLAIN = "replace(trim(coalesce(text, '')), '’', chr(39))"


@query(
    rf"""SELECT doc_id, {sql_us("coalesce(text, '')")} AS us, '/' || regexp_replace({sql_uk("coalesce(text, '')")}, '\s+', '', 'g') || '/' AS uk,
CASE WHEN regexp_full_match({PLAIN}, '[A-Za-z]+(?:[\x27-][A-Za-z]+)*') THEN lower({PLAIN}) END AS word FROM documents"""
)
def ipa_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20, M21, M23, on whole texts."""
    ship(spark)

    @F.pandas_udf("string")
    def word(s: pd.Series) -> pd.Series:
        return s.map(ipa.lookup_word, na_action="ignore")

    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", ipa.us_column(text).alias("us"), ipa.uk_column(text).alias("uk"), word("text").alias("word"))


SAID = "translate(word, 'erl', 'əɹɫ')"


@query(
    rf"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents)
SELECT 'us' AS accent, word, {sql_us(f"'/' || CASE WHEN length(word) % 2 = 0 THEN 'ˈ' ELSE '' END || {SAID} || '/'")} AS ipa FROM w WHERE length(word) % 5 <> 0
UNION ALL SELECT 'uk', word, '/' || {sql_uk(SAID)} || '/' FROM w WHERE length(word) % 5 NOT IN (0, 1)"""
)
def ipa_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15, D22, M20, M21, M22: dictionary files of all words of documents, read again. Words of some lengths have several
    pronunciations; in the American file others have an older line above."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    said, many = F.expr(SAID), F.length("word") % 5
    root = folder(spark)
    first = F.concat("word", F.lit("\t/old/\n"), F.upper("word"), F.lit("\t/"), F.when(F.length("word") % 2 == 0, "ˈ").otherwise(""), said, F.lit("/"))
    words.select(F.when(many == 0, F.concat("word", F.lit("\t/a/, /b/"))).otherwise(first)).write.text(f"{root}/us")
    line = F.concat(F.upper("word"), F.lit(", "), F.array_join(F.split(said, ""), " "))
    words.select(F.when(many == 0, F.concat("word", F.lit("(1), a b"))).when(many == 1, F.concat(line, F.lit("\n"), line)).otherwise(line)).write.text(f"{root}/uk")
    read = [files.read_pronunciations(spark, f"{root}/{a}", a).select(F.lit(a).alias("accent"), "word", "ipa") for a in ("us", "uk")]
    return read[0].unionByName(read[1])

"""Queries on task queues, agents' answers, section titles and layout packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import url as U
from quire.operators import derive, queue, verify
from quire.plans.registry import query, table
from quire.plans.runs import STATUS, STATUS_SQL, events
from quire.plans.texts import HREF, STRIP


@query("SELECT event_id, user_id % 4 AS priority, row_number() OVER (ORDER BY user_id % 4 DESC, event_id) - 1 AS position FROM events")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority, then first come first served."""
    tasks = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("priority"))
    return queue.ordered(tasks, "priority", "event_id")


@query(f"SELECT user_id % 10 AS queue, {', '.join(f'count(*) FILTER (s = {chr(39)}{s}{chr(39)}) AS {s}' for s in STATUS)}, count(*) AS total FROM (SELECT user_id, {STATUS_SQL} AS s FROM events) GROUP BY ALL")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and past tasks of a queue by status."""
    return queue.by_status(events(spark, sf_dir).withColumn("queue", F.col("url") % 10), "queue", STATUS)


HISTORY = "WITH l AS (SELECT event_type AS queue, user_id AS task, max(event_id) AS seq, arg_max({v}, event_id) AS v FROM events {where} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq DESC) AS age FROM l) SELECT queue, task, seq, v, age::INT AS age FROM r WHERE age <= {most}"


@query(HISTORY.format(v=STATUS_SQL, where="", most=100))
def task_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 100 tasks of each queue; a task that ran again counts once, by its last end."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), F.col("user_id").alias("task"), F.col("event_id").alias("seq"))
    e = e.withColumn("v", F.element_at(F.array(*map(F.lit, STATUS)), (F.col("seq") % 5 + 1).cast("int")))
    return queue.history(e, "queue", "task", "seq")


@query(HISTORY.format(v="value", where="WHERE event_id % 5 = 1", most=10))
def error_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 10 failures of each queue."""
    e = table(spark, sf_dir, "events").where("event_id % 5 = 1")
    return queue.history(e.select(F.col("event_type").alias("queue"), F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.col("value").alias("v")), "queue", "task", "seq", 10)


@query(
    """WITH a AS (SELECT conv_id, count(*) AS lines, arg_max(text, turn) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id)
SELECT conv_id, lines, CASE WHEN said IS NULL THEN NULL ELSE said END AS answer, CASE WHEN said IS NULL THEN 'no final message' WHEN conv_id % 5 = 0 THEN 'not JSON' END AS error FROM a"""
)
def agent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of events, some not JSON; the last agent message, out of its fence, parsed."""
    rows = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("```JSON\n"), F.to_json(F.struct(F.col("text").alias("answer"))), F.when(F.col("conv_id") % 5 == 0, "").otherwise("\n```"))
    body = F.when(F.col("conv_id") % 5 == 0, F.concat(body, F.lit(" trailing"))).otherwise(body)
    kind = F.when(F.col("role") == "assistant", "agent_message").otherwise("reasoning")
    line = F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(kind.alias("type"), body.alias("text")).alias("item")))
    lines = rows.select("conv_id", F.col("turn").alias("line_no"), line.alias("line"), "text")
    noise = rows.select("conv_id", (F.col("turn") + 1000).alias("line_no"), F.lit('{"type":"item.completed","item":').alias("line"), F.lit(None).cast("string").alias("text"))
    found = derive.final_messages(lines.drop("text").unionByName(noise.drop("text")), "conv_id", "line_no", "line")
    said = lines.groupBy("conv_id").agg(F.max_by(F.when(F.col("line").contains('"agent_message"'), F.col("text")), F.when(F.col("line").contains('"agent_message"'), F.col("line_no"))).alias("said"))
    out = found.join(said, "conv_id")
    answer = F.when(F.col("error").isNull(), F.get_json_object("json", "$.answer")).otherwise(F.col("said"))
    return out.select("conv_id", (F.col("lines") / 2).cast("long").alias("lines"), answer.alias("answer"), "error")


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text END AS answer,
CASE doc_id % 6 WHEN 3 THEN 'no structured output' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'not JSON' END AS error,
CASE doc_id % 6 WHEN 3 THEN ['response', 'status'] END AS keys, CASE doc_id % 6 WHEN 3 THEN length(text) END AS response_length FROM documents"""
)
def envelope_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer under either name of an envelope, as an object or as its JSON; else what is wrong with it."""
    k, answer = F.col("doc_id") % 6, F.struct(F.col("text").alias("answer"))
    envelope = (
        F.when(k == 0, F.to_json(F.struct(answer.alias("structured_output"), F.lit("x").alias("response"))))
        .when(k == 1, F.to_json(F.struct(F.to_json(answer).alias("structuredOutput"))))
        .when(k == 2, F.to_json(F.struct(answer.alias("structured_output"), F.struct(F.lit(1).alias("answer")).alias("structuredOutput"))))
        .when(k == 3, F.to_json(F.struct(F.lit("done").alias("status"), F.col("text").alias("response"))))
        .when(k == 4, F.concat(F.lit("done: "), F.to_json(answer)))
        .otherwise(F.to_json(F.struct(F.lit("{").alias("structured_output"))))
    )
    out = table(spark, sf_dir, "documents").select("doc_id", derive.structured_output(envelope).alias("r"))
    return out.select("doc_id", F.get_json_object("r.json", "$.answer").alias("answer"), "r.error", "r.keys", F.col("r.response_length").cast("long").alias("response_length"))


ENTRY = "CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {href}[2] || '/?from=x' WHEN 1 THEN url ELSE 'https://none.example.org/a' END"
LINK = rf"""regexp_extract_all(regexp_replace({STRIP}, '(?s)<!--.*?-->', '', 'g'), '(?is)<a\b[^>]*?\shref\s*=\s*["''][^"'']*["''][^>]*>(.*?)</a>', 1)"""


@query(
    rf"""WITH p AS (SELECT page_id, url, {ENTRY.format(href=HREF)} AS entry, {HREF} AS href, {LINK} AS said, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h1 FROM pages),
l AS (SELECT page_id, unnest(href) AS href, unnest(said) AS said, unnest(range(len(href))) AS n FROM p),
m AS (SELECT page_id, arg_min(trim(regexp_replace(l.said, '<[^>]+>', '', 'g')), n) AS title FROM l JOIN p USING (page_id)
      WHERE regexp_replace(CASE WHEN starts_with(l.href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || l.href ELSE l.href END, '/$', '') = regexp_replace(regexp_replace(entry, '[?#].*$', ''), '/$', '')
      AND trim(regexp_replace(l.said, '<[^>]+>', '', 'g')) <> '' GROUP BY page_id)
SELECT page_id, entry, coalesce(title, CASE WHEN h1 <> '' THEN h1 END) AS title FROM p LEFT JOIN m USING (page_id)"""
)
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18, HT19: the text of the first link to a section's entry page, else the first heading."""
    html, url, k = F.col("html"), F.col("url"), F.col("page_id") % 3
    linked = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.try_element_at(T.hrefs(html), F.lit(2)), F.lit("/?from=x"))
    rows = table(spark, sf_dir, "pages").withColumn("entry", F.when(k == 0, linked).when(k == 1, url).otherwise("https://none.example.org/a"))
    links = F.arrays_zip(T.hrefs(html).alias("href"), T.link_texts(html).alias("text"))
    same = F.filter(links, lambda x: (U.comparable(U.resolve(x["href"], url)) == U.comparable(F.col("entry"))) & (x["text"] != ""))
    return rows.select("page_id", "entry", F.coalesce(F.try_element_at(same, F.lit(1))["text"], T.first_heading(html)).alias("title"))


@query(
    """WITH p AS (SELECT 'pack-' || (doc_id % 40) AS id, doc_id, '{"id":"pack-' || (doc_id % 40) || '","page":{"height":' || (200 + doc_id % 7) || ',"width":148}}' AS spec FROM documents),
f AS (SELECT id, arg_min(spec, doc_id) AS spec, count(*) AS registered FROM p GROUP BY id)
SELECT 'pack-' || (d.doc_id % 50) AS layout, d.doc_id, sha256(f.spec) AS fingerprint, CASE WHEN f.id IS NULL THEN 'unknown' WHEN registered > 1 THEN 'duplicate' END AS issue
FROM documents d LEFT JOIN f ON f.id = 'pack-' || (d.doc_id % 50)"""
)
def layout_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs by id with the fingerprint of their canonical JSON; repeated and unknown ids are issues."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    spec = F.struct(F.concat(F.lit("pack-"), (F.col("doc_id") % 40).cast("string")).alias("id"), F.struct((200 + F.col("doc_id") % 7).alias("height"), F.lit(148).alias("width")).alias("page"))
    packs = d.select(spec.alias("spec"), F.col("doc_id").alias("seq"))
    asked = d.select(F.concat(F.lit("pack-"), (F.col("doc_id") % 50).cast("string")).alias("layout"), "doc_id")
    return verify.resolve_packs(packs, asked, "layout").select("layout", "doc_id", "fingerprint", "issue")

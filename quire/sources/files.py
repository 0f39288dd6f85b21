"""Readers and writers of documents, sections, states and reports, with declared schemas."""

from __future__ import annotations

import copy
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ipa
from quire.session import ship

PAGES = "page_id long, url string, html string"
SECTIONS = "index int, title string, entryUrl string, pages array<struct<index:string,url:string,order:int>>"
STATE = "version int, runIdentity string, artifacts map<string,struct<path:string,sha256:string>>, processedUrls array<string>, failedUrls array<struct<url:string,error:string>>, urlToIndex map<string,int>, startTime string, savedAt string"
FAILURES = "url string, index int, timestamp string"


def read_json(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """JSON with a schema; a missing path is an empty table unless it is required."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], schema)


def read_markdown(spark: SparkSession, folder: str, variant: str = "") -> DataFrame:
    """(name, position, text, sha256) of a folder's Markdown files of one variant, by numeric prefix."""
    from quire.operators.book import document_files

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))
    return document_files(rows, "name", variant)


def read_pronunciations(spark: SparkSession, path: str, accent: str = "us") -> DataFrame:
    """(word, ipa) of a dictionary file, in normal form.

    ``us``: word, tab, /signs/; lines with several pronunciations are left out, of repeated words the last line counts.
    ``uk``: word, comma, signs between spaces; numbered variants are left out, words of several lines too.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    mark = "\t" if accent == "us" else ","
    cut = lines.withColumn("cut", F.locate(mark, "value")).where("cut > 1")
    said = F.regexp_replace(F.expr("substring(value, cut + 1)"), r"^\s+|\s+$", "")
    cut = cut.select("at", F.expr("substring(value, 1, cut - 1)").alias("word"), said.alias("said"))
    if accent == "us":
        fit = cut.where(~F.col("said").contains(", ") & F.col("said").rlike("^/[^/]+/$"))
        return fit.groupBy(F.lower("word").alias("word")).agg(ipa.us_column(F.max_by("said", "at")).alias("ipa"))
    ship(spark)
    fit = cut.withColumn("word", F.lower(F.trim("word"))).where(~F.col("word").rlike(r"\(\d+\)$") & (F.col("said") != ""))
    once = fit.groupBy("word").agg(F.count("*").alias("n"), F.min("said").alias("said")).where("n = 1")
    return once.select("word", ipa.uk_column(F.col("said")).alias("ipa"))


def write_variants(rows: DataFrame, folder: str) -> None:
    """Documents (name, variant, text) as Parquet by variant: always the source, then translated or annotated."""
    rows.write.mode("overwrite").partitionBy("variant").parquet(folder)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as JSON lines; readers see all of it or none."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def merge_log(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A log with rows added whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def deep_merge(base: dict, *layers: dict) -> dict:
    """Objects merge, arrays and scalars replace."""
    out = copy.deepcopy(base)
    for layer in layers:
        for k, v in layer.items():
            out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def canonical(value) -> str:  # noqa: ANN001
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def dotted(value: dict, path: str, default=None):  # noqa: ANN001, ANN201
    for k in path.split("."):
        if not isinstance(value, dict) or k not in value:
            return default
        value = value[k]
    return value


#: Settings that don't change what a run acquires.
IRRELEVANT = {"_runtime", "logLevel", "concurrency", "network", "queue", "state", "python", "output", "retryFailedUrls", "maxRetries", "retryDelay", "pageTimeout"}


def run_identity(urls: list[str], config: dict, batch: bool = False) -> str:
    """SHA-256 of the URLs in order and of what the settings acquire."""
    import hashlib

    kept = {k: v for k, v in config.items() if k not in IRRELEVANT and not (batch and k == "pdf")}
    return hashlib.sha256(canonical({"version": 1, "urls": urls, "acquisition": kept}).encode()).hexdigest()

"""Run state: status events to states, totals, repairs and resumable artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ["success", "failed", "skipped"]


def latest(events: DataFrame, key: str, order: str = "event_seq") -> DataFrame:
    """The last status of each key, with counts of events; maxima and counts are pre-aggregated."""
    return events.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max(order).alias("last_seq"), F.sum((F.col("status") == "retrying").cast("long")).alias("retries"), F.count("*").alias("events"))


def progress(states: DataFrame, total: int | None = None) -> DataFrame:
    """Totals over final states of unique keys."""
    n = F.count("*") if total is None else F.lit(total)
    done = F.count_if(F.col("status").isin(FINAL))
    out = states.agg(n.alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), done.alias("processed"), F.sum("retries").alias("retried"))
    return out.withColumns({"pending": F.greatest(F.col("total") - F.col("processed"), F.lit(0)), "percentage": F.when(F.col("total") > 0, F.round(F.col("processed") / F.col("total") * 100, 2)).otherwise(0.0)})


def rates(stats: DataFrame, elapsed: str) -> DataFrame:
    """Rate a second, and seconds left at that rate (0 when nothing is left)."""
    rate = F.when(F.col("processed") > 0, F.col("processed") / F.col(elapsed)).otherwise(0.0)
    left = F.greatest(F.col("total") - F.col("processed"), F.lit(0))
    return stats.withColumns({"rate": F.round(rate, 6), "eta_s": F.when((left > 0) & (rate > 0), F.round(left / rate)).otherwise(0.0)})


def repaired(processed: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Keys that are both: failed wins."""
    return processed.join(failed.select(key).distinct(), key, "left_anti")


def resumable(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Artifacts (url, path, sha256) whose file is there with the same checksum."""
    found = files.select("path", F.col("sha256").alias("found"))
    return artifacts.join(found, "path", "left").select("url", "path", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("resumable"), F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").alias("problem"))


def manifest_violations(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (rule, index): repeated index or url, a url or checksum unlike the page's, pages and artifacts without each other."""
    twice = [manifest.groupBy(c).agg(F.count("*").alias("n"), F.min("index").alias("i")).where("n > 1").select(F.lit(f"repeated_{c}").alias("rule"), F.col("i").alias("index")) for c in ("index", "url")]
    both = manifest.alias("m").join(pages.alias("p"), F.col("m.index") == F.col("p.index"), "full_outer")
    checks = {"unmapped": F.col("p.index").isNull(), "missing": F.col("m.index").isNull(), "url": F.col("m.url") != F.col("p.url"), "checksum": F.col("m.sha256") != F.col("p.sha256")}
    each = both.select(F.coalesce("m.index", "p.index").alias("index"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in checks.items()]))).alias("rule"))
    return each.select("rule", "index").unionByName(twice[0]).unionByName(twice[1])

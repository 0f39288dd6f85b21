"""Retry schedules, error classes, lengths, formats and keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories in the order of their tests, and the texts that an error of each holds.
ERROR_RULES = [
    ("ignorable_js", ["Invariant: attempted to hard navigate", "Navigation cancelled by a newer navigation", "ResizeObserver loop limit exceeded"]),
    ("retryable_network", ["ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "ECONNREFUSED", "net::ERR_NETWORK_CHANGED", "net::ERR_INTERNET_DISCONNECTED"]),
    ("retryable_timeout", ["Navigation timeout", "timeout", "Timeout"]),
    ("retryable_browser", ["获取浏览器超时", "页面创建失败", "Browser closed", "Target closed"]),
    ("retryable_network", ["HTTP 5", "502", "503", "504"]),
    ("permanent_http", ["HTTP 4", "404", "403", "401"]),
    ("permanent_validation", ["页面内容未找到", "Invalid selector"]),
    ("system_error", ["ENOSPC", "EMFILE", "ENOMEM"]),
]
#: Category -> attempts, first delay in ms, factor, largest delay in ms.
RETRIES = {"retryable_network": (5, 2000, 1.5, 30000), "retryable_timeout": (3, 5000, 2.0, 60000), "retryable_browser": (3, 10000, 2.0, 60000)}
#: Page errors that don't matter.
HARMLESS = [
    "Invariant: attempted to hard navigate to the same URL",
    "Navigation cancelled by a newer navigation",
    "AbortError: The operation was aborted",
    "ResizeObserver loop limit exceeded",
    "Script error.",
    "Non-Error promise rejection captured",
    "TypeError: Cannot read properties of null",
    "TypeError: Cannot read properties of undefined",
    "Notification is not defined",
    "require is not defined",
    "exports is not defined in ES module scope",
]
#: Points in a unit.
POINTS = {"mm": 72 / 25.4, "cm": 72 / 2.54, "in": 72.0, "pt": 1.0, "px": 0.75}
#: Page sizes in mm.
PAGES = {"A3": (297.0, 420.0), "A4": (210.0, 297.0), "A5": (148.0, 210.0), "Letter": (215.9, 279.4), "Legal": (215.9, 355.6)}


def holds_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def error_category(message: Column) -> Column:
    out = F.lit("unknown")
    for name, parts in reversed(ERROR_RULES):
        out = F.when(holds_any(message, parts), F.lit(name)).otherwise(out)
    return out


def is_retryable(category: Column) -> Column:
    return category.isin(list(RETRIES))


def retry_strategy(category: Column) -> Column:
    def field(k: int, default: float) -> Column:
        out = F.lit(default)
        for name, values in RETRIES.items():
            out = F.when(category == name, F.lit(float(values[k]))).otherwise(out)
        return out

    return F.struct(*[field(k, d).alias(n) for k, (n, d) in enumerate([("attempts", 1.0), ("delay_ms", 0.0), ("factor", 1.0), ("cap_ms", 0.0)])])


def retryable_navigation(name: Column, message: Column) -> Column:
    return ~F.coalesce(name == "ValidationError", F.lit(False)) & ~F.coalesce(message.rlike(r"HTTP 4\d\d"), F.lit(False))


def backoff(attempt: Column, delay: Column, cap: Column) -> Column:
    """delay * 2**attempt, cut at the cap."""
    return F.least(delay * F.pow(F.lit(2.0), attempt), cap)


def jittered(base: Column, previous: Column, cap: Column, strategy: str, seed: int | None = None, draw: Column | None = None) -> Column:
    """``draw``: a number in [0, 1) instead of a random one."""
    u = F.rand(seed) if draw is None else draw
    drawn = {"none": base, "full": base * u, "equal": base / 2 + base * u / 2, "decorrelated": base + u * (F.coalesce(previous, base) * 3 - base)}[strategy]
    return F.round(F.least(drawn, cap))


def retry_after_ms(value: Column, now: Column, most_s: int = 30) -> Column:
    """Seconds or an HTTP date to ms; null where neither or above the limit."""
    seconds = value.try_cast("double")
    until = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, F.greatest(F.unix_timestamp(until) - F.unix_timestamp(now), F.lit(0)).cast("double"))
    return F.when(wait <= most_s, wait * 1000)


def points(length: Column) -> Column:
    """A length with a unit in points; null for anything else."""
    number = F.regexp_extract(length, r"^\s*(\d+(?:\.\d+)?)\s*(mm|cm|in|pt|px)\s*$", 1)
    unit = F.regexp_extract(length, r"^\s*(\d+(?:\.\d+)?)\s*(mm|cm|in|pt|px)\s*$", 2)
    factor = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in POINTS.items()])
    return number.try_cast("double") * factor


def page_points(name: Column, side: int) -> Column:
    return F.coalesce(*[F.when(F.lower(name) == n.lower(), F.lit(mm[side] * 72 / 25.4)) for n, mm in PAGES.items()])


def duration(seconds: Column, s: str = "s", m: str = "m", h: str = "h") -> Column:
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(s)))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(m), (seconds % 60).cast("string"), F.lit(s)))
        .otherwise(F.concat(hours.cast("string"), F.lit(h), (minutes % 60).cast("string"), F.lit(m)))
    )


def image_format(data: Column) -> Column:
    """Format by the first bytes, or null."""
    head = F.hex(F.substring(data, 1, 12))
    text = F.lower(F.ltrim(F.decode(F.substring(data, 1, 512), "UTF-8")))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("255044462D"), "pdf")
        .when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("61766966", "61766973"), "avif")
        .when(text.contains("<svg"), "svg")
    )


def translation_key(provider: Column, variant: Column, model: Column, language: Column, mode: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(x, F.lit("")) for x in (provider, variant, model, language, mode, text)]))


def digest_key(kind: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws(":", kind, url), 256)


def running_mean_rounded(values: Column) -> Column:
    """Mean that is rounded after each value."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["n"] + 1).alias("n"), F.round((a["mean"] * a["n"] + x) / (a["n"] + 1)).alias("mean")), lambda a: a["mean"])


def fold_running_means(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(group, mean, n) of frames (group, value) that hold each group's values together and in order: block by block."""
    group, mean, n = None, 0.0, 0
    for f in frames:
        out = []
        for g, x in zip(f["group"], f["value"], strict=True):
            if n and g != group:
                out.append((group, mean, n))
                mean, n = 0.0, 0
            group, n = g, n + 1
            total = (mean * (n - 1) + x) / n
            mean = float(math.floor(total + 0.5) if total >= 0 else math.ceil(total - 0.5))  # as F.round
        yield pd.DataFrame(out, columns=["group", "mean", "n"])
    if n:
        yield pd.DataFrame([(group, mean, n)], columns=["group", "mean", "n"])


def running_means(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, mean, n): the mean of each group's values in order, rounded after each. A task reads its groups as a sorted
    stream, so no group is one value; the fold of one group is one task's work."""
    kept = rows.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    ordered = kept.where("value is not null").repartition("group").sortWithinPartitions("group", "order")
    return ordered.select("group", "value").mapInPandas(fold_running_means, "group string, mean double, n long")


def column_count(rows: Column) -> Column:
    """Columns of a table (array of rows, each an array of cells): the width of its widest row, 0 without rows."""
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def json_object(text: Column) -> Column:
    """From the first { to the last }, if that parses, else null."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def progress_line(text: Column) -> Column:
    pattern = r"Progress: (\d+)/(\d+) files processed"
    return F.struct(F.regexp_extract(text, pattern, 1).try_cast("int").alias("done"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("total"))


def compacted(text: Column) -> Column:
    """Without white space, with plain quotes and ligatures spelled out."""
    out = F.translate(text, "‘’“”", "''\"\"")
    for k, v in zip("ﬀﬁﬂﬃﬄﬅﬆ", ["ff", "fi", "fl", "ffi", "ffl", "st", "st"], strict=True):
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, r"[\s ]+", "")


def contains_text(expected: Column, actual: Column) -> Column:
    joined = F.regexp_replace(actual, r"(?<=\w)-\s*\n\s*(?=\w)", "")
    return F.contains(compacted(actual), compacted(expected)) | F.contains(compacted(joined), compacted(expected))


def font_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+", "")), "[^a-z0-9]", "")


def fonts_match(expected: Column, actual: Column) -> Column:
    a, b = font_name(expected), font_name(actual)
    return F.contains(b, a) | F.contains(a, b)

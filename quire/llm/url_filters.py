"""URL filters: pattern rules found through their rarest literal token, in DataFrame functions only."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.storage import Scratch

#: What separates tokens of a URL.
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Prefix:
    """Verdict for a host, its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Pattern:
    """A blocking rule: a regular expression (Java and RE2) on the lower-cased url. ``words``: tokens that each match holds
    whole; a rule without any is a candidate for every url."""

    name: str
    regex: str
    words: tuple[str, ...]


def literal_tokens(regex: str) -> tuple[str, ...]:
    """Tokens that every match of a pattern holds as whole tokens.

    Read off conservatively: alternatives, groups and quantified characters give none; a run of literal letters and
    digits counts if a literal separator, a class of separators or an anchor stands at both its ends.
    """
    if "|" in regex or "(" in regex or "(?" in regex:
        return ()
    parts: list[str | None] = []  # a literal character, or None for what isn't one
    at = 0
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            parts.append(regex[at + 1] if not regex[at + 1].isalnum() else None)
            at += 2
        elif c == "[":
            end = regex.index("]", at + 2) + 1
            parts.append(None if re.search(r"[\^a-z0-9\\]", regex[at:end]) else "\n")
            at = end
        elif c in "*+?{":
            if parts:
                parts[-1] = None
            at = regex.index("}", at) + 1 if c == "{" else at + 1
        elif c in "^$":
            parts.append("\n")
            at += 1
        else:
            parts.append(None if c == "." else c)
            at += 1
    text = "".join("\x00" if p is None else p for p in parts)
    return tuple(dict.fromkeys(m[1] for m in re.finditer(rf"(?<=[^a-z0-9\x00])({TOKEN})(?=[^a-z0-9\x00])", text)))


def pattern(name: str, regex: str) -> Pattern:
    return Pattern(name, regex, literal_tokens(regex))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def prefix_verdict(host: Column, path: Column, rules: list[Prefix]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together; the first of equals) and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(enumerate(rules), key=lambda x: (len(x[1].host + x[1].path), -x[0])):
        fits = ((host == r[1].host) | host.endswith("." + r[1].host)) & path.startswith(r[1].path)
        rule, verdict = F.when(fits, r[1].host + r[1].path).otherwise(rule), F.when(fits, r[1].verdict).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit(f"({TOKEN})"), 1))


def rule_table(pages: DataFrame, patterns: list[Pattern], url: str) -> DataFrame:
    """(token, name, regex): each rule under that of its tokens which the fewest URLs of the whole table hold; null where it
    has none. Frequencies are pre-aggregated, and only of tokens that rules have."""
    spark = pages.sparkSession
    rules = spark.createDataFrame([(p.name, p.regex, list(p.words)) for p in patterns], "name string, regex string, words array<string>")
    words = rules.select(F.explode("words").alias("token")).distinct()
    counts = pages.select(F.explode(tokens_of(F.col(url))).alias("token")).join(words, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("name", "regex", F.explode_outer("words").alias("token")).join(counts, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token"))
    return each.groupBy("name", "regex").agg(rarest.alias("token")).select("token", "name", "regex")


def matched(url: Column, rules: list[tuple[str | None, str, str]]) -> Column:
    """Name of the first rule (token, name, regex), by name, that the url matches, or null.

    The index is an array of buckets in the plan: a URL token's hash names its bucket, the rules under that token are
    candidates, and only they and those without a token are run.
    """
    size = 1 << max(4, (2 * len(rules) - 1).bit_length())
    lowered = F.lower(F.coalesce(url, F.lit("")))
    kind = "array<struct<token:string,name:string,regex:string>>"
    listed = lambda found: F.array(*[F.struct(F.lit(t).alias("token"), F.lit(n).alias("name"), F.lit(r).alias("regex")) for t, n, r in found]).cast(kind)
    buckets: list[list[tuple]] = [[] for _ in range(size)]
    for rule in rules:
        if rule[0] is not None:
            buckets[zlib.crc32(rule[0].encode()) % size].append(rule)
    table = F.array(*map(listed, buckets))
    fetched = F.flatten(F.transform(tokens_of(url), lambda t: F.filter(F.element_at(table, (F.crc32(t.cast("binary")) % size + 1).cast("int")), lambda r: r["token"] == t)))
    candidates = F.concat(fetched, listed([r for r in rules if r[0] is None]))
    return F.array_min(F.transform(F.filter(candidates, lambda r: F.regexp_like(lowered, r["regex"])), lambda r: r["name"]))


def joined(pages: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """``pages`` with pattern, as ``matched`` gives it, by joins: for lists of rules of any length. Urls meet the rules of
    their tokens; a url goes through the shuffle once a distinct url, and only its matches come back."""
    urls = pages.select(F.lower(F.col(url)).alias("__url")).where("__url is not null").distinct()
    bound = urls.withColumn("token", F.explode(tokens_of(F.col("__url")))).join(rules.where("token is not null"), "token")
    free = urls.withColumn("__rules", F.lit(1)).join(rules.where("token is null").select(F.lit(1).alias("__rules"), "name", "regex"), "__rules")
    hits = bound.select("__url", "name", "regex").unionByName(free.select("__url", "name", "regex")).where(F.expr("regexp_like(__url, regex)"))
    first = hits.groupBy("__url").agg(F.min("name").alias("pattern"))
    return pages.withColumn("__url", F.lower(F.col(url))).join(first, "__url", "left").drop("__url")


def filter_urls(pages: DataFrame, prefixes: list[Prefix], patterns: list[Pattern], url: str = "url", key: str = "page_id", most: int = 2000) -> DataFrame:
    """Per row: key, host, path, rule, verdict (allow or block), pattern (name of the pattern rule that matched, or null).

    A prefix rule that fits decides, the longest first (of equal lengths the first given); else a url that matches a
    pattern is blocked, any other allowed. Up to ``most`` patterns are an index in the plan: no join and no shuffle of
    urls, so a common host or token is one row's work wherever it stands. Longer lists are joined as a table by token, with
    the same rows (``joined``). Token frequencies come from the whole table in one pre-aggregated pass.

    Null url or one without ``://``: host and path empty; patterns still run on its text. Very long urls are no special
    case. Each input row gives one row, an empty table none; other columns aren't read, so their names can't clash.
    """
    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__text"))
    if not patterns:
        rows = rows.withColumn("pattern", F.lit(None).cast("string"))
    elif len(patterns) <= most:
        rules = [tuple(r) for r in rule_table(rows, patterns, "__text").collect()]  # a row for each pattern, ``most`` at most
        rows = rows.withColumn("pattern", matched(F.col("__text"), sorted(rules, key=lambda r: r[1])))
    else:
        scratch = Scratch(pages.sparkSession)
        rows = joined(rows, scratch.put(rule_table(rows, patterns, "__text"), "rules"), "__text")
    rows = rows.select("__key", host_of(F.col("__text")).alias("host"), path_of(F.col("__text")).alias("path"), "pattern")
    rule, verdict = prefix_verdict(F.col("host"), F.col("path"), prefixes)
    method = F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    return rows.select(F.col("__key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "pattern")

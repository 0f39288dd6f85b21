"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD_BREAKS
from quire.storage import Scratch

#: Words in a window of the repetition count.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A row fails if ``fails`` (SQL over the text and the counts) is true."""

    name: str
    fails: str


#: Limits that leave prose of any language alone; {text} is the text, never null.
RULES = [
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "10 * length(regexp_replace({text}, '[^\\\\p{{Lu}}]+', '')) > 4 * length(regexp_replace({text}, '[^\\\\p{{L}}]+', '')) and n_words >= 5"),
    Rule("word_length", "word_chars > 15 * n_words or word_chars < 2 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > size(split({text}, '\\n', -1))"),
    Rule("digits", "10 * length(regexp_replace({text}, '[^0-9]+', '')) > 4 * word_chars"),
    Rule("letters", "10 * length(regexp_replace({text}, '[^\\\\p{{L}}]+', '')) < 3 * word_chars"),
]


#: White space that separates words, as characters.
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAKS, -1))


def _pairs(hashes: str, apart: int) -> Column:
    """Hashes of the spans that begin ``apart`` places after each other, joined two by two."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda x, y: F.xxhash64(x, y))


def measured(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __text and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows: hashes of words are joined to hashes of two, four and eight words. Windows found twice hold at least
    five spans of four words found twice, so eights are made only for texts with as many of those. They are sorted with
    their places only if any two are equal; places next to an equal hash are repeats, and each adds the words up to the
    next repeat, a window's width at most.
    """
    step = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__words", words_of(F.col("__text")))
    lines = F.filter(F.split("__text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    count = lambda chars: F.length(F.regexp_replace("__text", f"[^{chars}]+", "")).cast("long")
    step = step.withColumns(
        {
            "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
            "__lines": lines,
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length("__text") - count("\\x20\\x09-\\x0D"),
            "n_symbols": count("#*$%&|<>"),
        }
    ).drop("__words")
    step = step.withColumns({"__twos": _pairs("__hashes", 1), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__hashes", "__lines")
    step = step.withColumn("__fours", _pairs("__twos", 2)).drop("__twos")
    often = F.size("__fours") - F.size(F.array_distinct("__fours")) >= WINDOW - 3
    step = step.withColumn("__windows", F.when(often, _pairs("__fours", 4))).drop("__fours")
    any_twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    step = step.withColumn("__sorted", F.when(any_twice, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    twice = F.filter("__sorted", lambda x, k: F.coalesce(x["h"] == F.get("__sorted", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__sorted", k + 1)["h"], F.lit(False)))
    step = step.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__sorted")
    covered = F.transform("__places", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__places", k + 1) - i, F.lit(WINDOW))).cast("long"))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return step.drop("__places")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _sql(rule: Rule) -> str:
    return rule.fails.format(text="__text")


def plan_order(rows: DataFrame, rules: list[Rule], rounds: int = 8, few: int = 256, timer: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """Rules by rejected rows per cost, both taken on the counted rows of a sample.

    The cost of a rule that reads the text is the time of ``rounds`` evaluations of each of ``few`` rows, less that of as
    many of a rule that does nothing, as a power of two of the cheapest: so neither a job's overhead nor noise decides.
    Rules over counts alone cost a sixteenth of the cheapest of those. Ties keep the order of ``rules``.
    """
    timed = rows.limit(few)

    def seconds(fails: str) -> float:
        again = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0), lambda a, _: a + F.expr(fails).cast("int"))
        began = timer()
        timed.agg(F.sum(again)).collect()
        return timer() - began

    rejected = rows.agg(F.count("*"), *[F.count_if(F.expr(_sql(r))) for r in rules]).first()
    reads = [r for r in rules if "{text}" in r.fails]
    idle = min(seconds("n_words < 0") for _ in range(2)) if len(reads) > 1 else 0.0
    costs = {r.name: max(seconds(_sql(r)) - idle, 0.005) if len(reads) > 1 else 1.0 for r in reads}
    steps = {r.name: round(math.log2(costs[r.name] / min(costs.values()))) if r in reads else -4 for r in rules}
    gain = {r.name: rejected[k + 1] / max(1, rejected[0]) / 2.0 ** steps[r.name] for k, r in enumerate(rules)}
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(order: list[Rule]) -> Column:
    """Name of the first rule that fails, in this order; later rules aren't evaluated for the row."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(F.expr(_sql(rule)), F.lit(rule.name)).otherwise(out)
    return out


def quality(docs: DataFrame, rules: list[Rule] = RULES, sample: int = 2000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, the counts of ``measured``, base_failed and kept.

    Base rules: under 20 words, or over 30 % of the words in repeated windows. Rows that pass go through ``rules``, the
    rule with the most rejections per second first; a row is kept if none fails. The order is estimated on a sample of
    ``sample`` rows and changes the cost, never ``kept``.

    Null text: no words, so the base rules fail. Texts of any length: one row's arrays, no limit. Null keys, repeated
    rows and empty tables are no special cases; each input row gives one row. Other columns aren't read. No shuffle.
    """
    rows = docs.select(key, F.col(text))
    scratch = Scratch(docs.sparkSession)
    sampled = rows.select(text)
    total = max(1, sampled.count())
    part = scratch.put(measured(sampled.sample(False, min(1.0, sample / total), seed=11), text), "measured")
    order = plan_order(part.where(~base_failed()), rules)  # written before the filter, which would else repeat the counts in itself
    scratch.clear()
    out = measured(rows, text).withColumn("base_failed", base_failed())
    out = out.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"))

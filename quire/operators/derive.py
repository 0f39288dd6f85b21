"""Derived content: only segments that no cache holds go to a client, in batches, and answers are checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A client takes {id: text} and gives {id: derived}; it may raise.
Client = Callable[[dict[str, str]], dict[str, str]]


def retrying(client: Client, attempts: int = 3, fallback: Client | None = None) -> Client:
    """Whole batch again, then each item alone, then the fallback for what is left."""

    def run(batch: dict[str, str]) -> dict[str, str]:
        out: dict[str, str] = {}
        for _ in range(attempts):
            try:
                out |= {k: v for k, v in client({k: t for k, t in batch.items() if k not in out}).items() if k in batch}
            except Exception:  # noqa: BLE001  a client may fail in any way
                continue
            if len(out) == len(batch):
                return out
        for k, t in batch.items():
            if k not in out:
                for c in (client, fallback):
                    try:
                        if c and (found := c({k: t}).get(k)):
                            out[k] = found
                            break
                    except Exception:  # noqa: BLE001
                        continue
        return out

    return run


def derive(rows: DataFrame, cache: DataFrame, client: Client, size: int = 5) -> DataFrame:
    """rows (id, key, text), cache (key, derived) -> (id, key, text, derived, cached); derived is null where the client
    failed. Equal keys are asked once."""
    known = rows.join(cache, "key", "left").withColumn("cached", F.col("derived").isNotNull())
    asked = rows.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), size):
                part = f.iloc[at : at + size]
                found = client(dict(zip(part["key"], part["text"], strict=True)))
                yield pd.DataFrame({"key": part["key"], "answer": [found.get(k) for k in part["key"]]})

    answers = asked.mapInPandas(run, "key string, answer string")
    return known.join(answers, "key", "left").select("id", "key", "text", F.coalesce("derived", "answer").alias("derived"), "cached")


def incomplete(rows: DataFrame) -> DataFrame:
    """Ids without an answer: fatal for a document."""
    return rows.where("derived is null").select("id")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def final_messages(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, lines, json, error): of each agent's lines of JSON events the last agent message, out of its code fence.

    Lines that aren't JSON are skipped; errors: no final message, not JSON. The last message is a pre-aggregated maximum.
    """
    event = F.from_json(line, "type string, item struct<type:string,text:string>")
    rows = lines.select(key, order, event.alias("e"))
    is_answer = (F.col("e.type") == "item.completed") & (F.col("e.item.type") == "agent_message")
    last = rows.groupBy(key).agg(F.count("*").alias("lines"), F.max_by("e.item.text", F.when(is_answer, F.col(order))).alias("text"), F.count_if(is_answer).alias("n"))
    body = F.regexp_replace(F.regexp_replace(F.trim("text"), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    parsed = last.select(key, "lines", F.when((F.col("n") > 0), body).alias("json"))
    error = F.when(F.col("json").isNull(), "no final message").when(~is_json(F.col("json")), "not JSON")
    return parsed.select(key, "lines", F.when(error.isNull(), F.col("json")).alias("json"), error.alias("error"))


def structured_output(envelope: Column) -> Column:
    """struct(json, error, keys, response_length): what an envelope holds as structured_output, else as structuredOutput; a
    string there is JSON itself. Where there is none, the envelope's keys and the length of its response."""
    given = F.coalesce(F.get_json_object(envelope, "$.structured_output"), F.get_json_object(envelope, "$.structuredOutput"))
    error = F.when(~is_json(envelope), "not JSON").when(given.isNull(), "no structured output").when(~is_json(given), "not JSON")
    none = error == "no structured output"
    return F.struct(
        F.when(error.isNull(), given).alias("json"),
        error.alias("error"),
        F.when(none, F.array_sort(F.json_object_keys(envelope))).alias("keys"),
        F.when(none, F.coalesce(F.length(F.get_json_object(envelope, "$.response")), F.lit(0))).alias("response_length"),
    )

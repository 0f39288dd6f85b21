"""Queues, agents' answers and layout packs on small cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.operators import derive, queue, verify


def test_order_and_history(spark):
    tasks = spark.createDataFrame([("a", 0, 1), ("b", 5, 2), ("c", 5, 3), ("d", -1, 4)], "id string, priority int, seq int")
    assert [r["id"] for r in queue.ordered(tasks).orderBy("position").collect()] == ["b", "c", "a", "d"]
    done = spark.createDataFrame([("q", "a", 1, "x"), ("q", "b", 2, "x"), ("q", "a", 3, "y"), ("q", "c", 4, "x"), ("r", "a", 9, "z")], "queue string, task string, seq int, v string")
    kept = {(r["queue"], r["task"], r["v"], r["age"]) for r in queue.history(done, "queue", "task", "seq", 2).collect()}
    assert kept == {("q", "c", "x", 1), ("q", "a", "y", 2), ("r", "a", "z", 1)}
    assert queue.history(done.where("false"), "queue", "task", "seq").count() == 0


def test_final_messages(spark):
    event = lambda kind, text: json.dumps({"type": "item.completed", "item": {"type": kind, "text": text}})
    lines = [
        ("one", [event("agent_message", '{"a": 0}'), event("reasoning", "x"), event("agent_message", '```json\n{"a": 1}\n```'), "not json", ""]),
        ("none", [event("reasoning", "{}"), json.dumps({"type": "item.started", "item": {"type": "agent_message", "text": "{}"}})]),
        ("bad", [event("agent_message", '{"a": 1} and more')]),
        ("fence", [event("agent_message", "``` \n[1, 2]```")]),
    ]
    rows = spark.createDataFrame([(k, n, x) for k, xs in lines for n, x in enumerate(xs)], "id string, n int, line string")
    got = {r["id"]: (r["json"], r["error"]) for r in derive.final_messages(rows, "id", "n", "line").collect()}
    assert got == {"one": ('{"a": 1}', None), "none": (None, "no final message"), "bad": (None, "not JSON"), "fence": ("[1, 2]", None)}


def test_structured_output(spark):
    cases = ['{"structured_output": {"a": 1}}', '{"structuredOutput": "[1]"}', '{"status": "x", "response": "abcd"}', '{"structured_output": null, "structuredOutput": {"b": 2}}', "[]", "{", '{"structured_output": "{"}', None]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, e string").select("k", derive.structured_output(F.col("e")).alias("r"))
    got = [tuple(r["r"]) for r in rows.orderBy("k").collect()]
    assert [g[:2] for g in got] == [('{"a":1}', None), ("[1]", None), (None, "no structured output"), ('{"b":2}', None), (None, "no structured output"), (None, "not JSON"), (None, "not JSON"), (None, "not JSON")]
    assert got[2][2:] == (["response", "status"], 4)


def test_layout_packs(spark):
    packs = spark.createDataFrame([(("a", 1), 1), (("a", 2), 2), (("b", 3), 3)], "spec struct<id:string,size:int>, seq int")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "layout string")
    got = {r["layout"]: (r["spec"], r["issue"]) for r in verify.resolve_packs(packs, asked, "layout").collect()}
    assert got == {"a": ('{"id":"a","size":1}', "duplicate"), "b": ('{"id":"b","size":3}', None), "c": (None, "unknown")}

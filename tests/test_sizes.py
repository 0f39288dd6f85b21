"""Queries on odd rows, against their SQL, and steps that must not grow faster than their input."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from quire import plans
from quire.functions import text as T
from quire.operators import book


def against_sql(spark, folder, name, table, rows):
    """Rows of a query and of its SQL on a table."""
    folder.mkdir(exist_ok=True)
    rows.toPandas().to_parquet(folder / f"{table}.parquet")
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    found = plans.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, found.collect()), key=repr), sorted(c.execute(f"select {', '.join(found.columns)} from ({plans.ORACLE[name]})").fetchall(), key=repr)


ODD = ["", " ", "\n\n", "\t", "a\n\t\nb", "\t\na\n\t", " \na", " a　\n \n b ", "\r\na\r\n", "﻿\n\u0085\nx", "a\n \n\nb\n", None]


def test_callout_of_blank_texts(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    found, wanted = against_sql(spark, tmp_path / "t", "callout_blockquote", "documents", rows)
    assert found == wanted and (0, "> **Note:**\n>\n") in found


def test_outline_and_ranges_across_blocks(spark):
    pages = spark.range(900).selectExpr("id % 2 AS book", "id AS index", "cast(floor(id / 30) AS string) AS section", "concat('t', id) AS title", "id * 3 + 1 AS start_page").repartition(5)
    rows = book.outline(pages, block=37)
    got = {(r["book"], r["seq"]): (r["level"], r["title"], r["page"]) for r in rows.collect()}
    want = {}
    for b in (0, 1):
        entries = []
        for k in range(b, 900, 2):
            if not entries or k // 30 != (k - 2) // 30:
                entries.append((1, str(k // 30), k * 3 + 1))
            entries.append((2, f"t{k}", k * 3 + 1))
        want |= {(b, n): e for n, e in enumerate(entries, 1)}
    assert got == want
    deep = rows.selectExpr("book", "seq", "cast(level + seq % 3 AS int) AS level", "title", "if(seq % 7 = 0, null, page) AS page")
    flat = {(r["book"], r["seq"]): r for r in deep.collect()}
    for block in (5, 37, 50_000):
        out = book.ranges(deep, block=block)
        assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()  # such a frame is added up anew for each row
        for r in out.collect():
            after = [flat[r["book"], n] for n in range(r["seq"] + 1, len(flat) // 2 + 1)]
            assert r["has_children"] == bool(after and after[0]["level"] > r["level"])
            assert r["next_page"] == next((x["page"] for x in after if x["level"] <= 2 and x["page"] is not None), None)


def python_nodes(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan.count("EvalPython"), plan.count("html#")


SF = "/root/testdata/sf0.001"


def test_pages_are_converted_once(spark):
    """Several readers of a table of segments read it from the shared folder."""
    for name in ("annotation_responses", "translated_markdown", "book_run"):
        nodes, html = python_nodes(plans.QUERIES[name](spark, SF))
        assert html == 0 and nodes <= 1, name


def test_one_worker_a_task(spark):
    for name in ("annotation_segments", "page_text_rules"):
        assert python_nodes(plans.QUERIES[name](spark, SF))[0] == 1, name


def test_text_rules_compute_their_text_once(spark):
    rows = spark.createDataFrame([("a  b\t`c`",), ("`x",), (" \n",), ("a b",), (None,)], "t string").select(T.inline_code(F.col("t")).alias("code"))
    assert [r["code"] for r in rows.collect()] == ["`` a b `c` ``", "`` `x ``", "", "`a b`", None]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_emphasis_looks_back_behind_underscores_only(spark):
    texts = ["漢_a_ b", "_a_漢", "x_a_漢", "__a_漢", "_a\n_漢", "한_é__漢_"]
    want = ["漢*a* b", "*a*漢", "x_a_漢", "__a_漢", "_a\n_漢", "한*é*_漢_"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.cjk_emphasis(F.col("t")).alias("out"))
    assert [r["out"] for r in rows.collect()] == want
    assert "(?<=[" not in rows._jdf.queryExecution().optimizedPlan().toString().replace("_(?<=[", "")  # else every place of a text looks back


def test_clamp_computes_its_row_once(spark):
    texts = ["|---|:--:|", "| :---: | " + "-" * 60 + " |", "---\r\n |---\r", "|--|---|", "|", "", None, "---|", "|:---"]
    want = ["|---|:--:|", "|:----------:|" + "-" * 50 + "|", "|----------|----------|", "|--|---|", "|", "", None, "|----------|", "|:----------|"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.clamp_separator(F.reverse(F.reverse("t"))).alias("out"))
    assert [r["out"] for r in rows.collect()] == want
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1

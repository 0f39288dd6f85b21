"""Queries on whole tables and texts, against plain loops over all rows."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from quire import plans
from quire.functions import ipa, misc
from quire.functions import text as T
from quire.html import operators as H
from quire.markdown import adapters
from quire.operators import book, frontier, verify
from quire.session import ship

SF = "/root/testdata/sf0.001"
SITE = [adapters.drop_copy_residue, adapters.unwrap_cards, adapters.one_theme, adapters.numbered_prompts, adapters.strip_pager]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def fences(text):
    return max((len(x) for x in re.findall("`+", text)), default=0)


def code(text):
    body = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
    fence, pad = "`" * (fences(body) + 1), " " if body.startswith("`") or body.endswith("`") else ""
    return fence + pad + body + pad + fence if body else ""


def images(text):
    parts = re.split(r"\n{2,}", text)
    one = lambda p: re.fullmatch(r"!\[[^\]]*\]\([^)]*\)", p.strip(" "))
    return "\n\n".join(p for k, p in enumerate(parts) if not (k and one(p) and p.strip(" ") == parts[k - 1].strip(" ")))


def captions(text):
    out, last = [], ""
    for line in text.split("\n"):
        t, alt = line.strip(" "), re.fullmatch(r"\s*!\[([^\]]*)\]\([^)]*\)\s*", last)
        key = lambda x: re.sub(r"[\s*_.]+", "", x).lower()
        if not (re.fullmatch(r"\*[^*]+\*|_[^_]+_", t) and alt and alt[1] and key(t[1:]) == key(alt[1])):
            out.append(line)
        last = line if t else last
    return "\n".join(out)


def heading(text):
    m = re.search(r"(?m)^##?[ \t]+(\S.*)$", text)
    return m[1].strip() if m else None


def breaks(code):
    return "|" in code or len(code) >= 12 and bool(re.search(r"[\\/._:\[\]-]", code) or re.search("[a-z][A-Z]", code) and not re.search(r"\s", code))


def pipe(text):
    lines = [x for x in text.split("\n") if x.strip(" ")]
    return len(lines) >= 2 and all("|" in x for x in lines)


def expected(text):
    return (heading(text), md5(code(text)), fences(text), md5(images(text)), md5(captions(text)), sum(map(breaks, re.findall(r"`([^`\n]+)`", text))), sum(map(pipe, re.split(r"\n{2,}", text))))


NAMES = ["heading", "code", "longest", "images", "captions", "breaks", "pipe_tables"]


def test_text_rules_read_whole_texts(spark):
    rows = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in plans.QUERIES["document_text_rules"](spark, SF).collect()}
    assert rows == {d: expected(t) for d, t in read("documents")[["doc_id", "text"]].itertuples(index=False)}


def test_text_rules_read_pages(spark):
    ship(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", T.html_title("html").alias("title"), H.markdown("html", "article").alias("md")).collect()
    assert len(pages) == 50 and all(p["md"] for p in pages)
    registry = adapters.Registry(adapters.Adapter("docs", ("example.org",), None, SITE))
    rows = {r["page_id"]: r for r in plans.QUERIES["page_text_rules"](spark, SF).collect()}
    for p in pages:
        assert tuple(rows[p["page_id"]][n] for n in NAMES) == expected(p["md"])
        assert rows[p["page_id"]]["adapted"] == md5(registry.clean(p["md"], p["url"]))
    assert any(rows[k]["title"] for k in rows)


def test_lists_hold_pages_beyond_sixty(spark, tmp_path):
    spark.range(1000).selectExpr("id AS page_id", "concat('u', id) AS url").write.parquet(f"{tmp_path}/pages.parquet")
    rows = [tuple(r) for r in plans.QUERIES["url_list_rows"](spark, str(tmp_path)).collect()]
    want = [(k, f"u{k}", 0, "Custom Selection", k) for k in range(1000)]
    want += [((s + 1 << 32) + n, f"u{k}", s + 1, f"part{s}", n) for s in range(3) for n, k in enumerate(range(s, 1000, 3))]
    assert sorted(rows) == sorted(want)


def test_whole_logs_and_verdicts(spark, tmp_path):
    spark.range(1000).selectExpr("id AS page_id", "concat('u', id) AS url").write.parquet(f"{tmp_path}/pages.parquet")
    log = plans.QUERIES["failure_log_all"](spark, str(tmp_path))
    assert {(r["url"], r["index"]) for r in log.collect()} == {(f"u{k}", k % m) for k in range(1000) for m in (3, 4)}
    assert tuple(plans.QUERIES["verify_verdict_all"](spark, str(tmp_path)).first()) == (1000, False, "0,1,2,3,4,5,6,7,8,9,10,11")


@given(st.text("ˈˌɝəʌærk/\n ", max_size=30))
@settings(max_examples=300, deadline=None)
def test_us_form_keeps_marks_and_leaves_no_narrow_sign(text):
    assert not set("ɝɹɫ") & set(ipa.us(text)) and re.sub("[^ˈˌ]", "", ipa.us(text)) == re.sub("[^ˈˌ]", "", text)


def test_pronunciations_of_whole_texts(spark, tmp_path):
    texts = ["abcdefghijklmnop", "abcdefghijkl mnop", "ˈsɪstəmz ən ˈwɝk ɝ", "Don’t-stop-at-the-twelfth", "kɝ " * 50_000, None]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["us"], r["uk"], r["word"]) for r in plans.QUERIES["ipa_normal_forms"](spark, str(tmp_path)).collect()}
    assert [got[k][2] for k in range(6)] == ["abcdefghijklmnop", None, None, "don't-stop-at-the-twelfth", None, None]
    assert [got[k][1] for k in (0, 1, 5)] == ["/abcdefɡhijklmnop/", "/abcdefɡhijklmnop/", "//"] and len(got[4][1]) == 100_002
    assert got[2][0] == ipa.us(texts[2]) == "ˈsɪstəmz ən ˈwɜːrk ər" and got[4][0] == "kər " * 50_000


def test_rules_of_whole_books():
    pages = [{"label": a, "text": t, "images": 0} for a, t in (("i", "Contents lost words"), ("1", "One\nsome hyphen-\nated text"), ("2", "Two\n 12 _"))]
    outline = [{"level": 2, "title": t, "page": p, "target": t} for t, p in (("One", 2), ("Two", 3))]
    expected = {"snippets": ["hyphenated", "text Two", "lost words"], "titles": ["One", "Two"], "require_toc": True, "min_toc_pages": 1, "require_images": True}
    kinds = lambda *x: [(i["kind"], i["page"], i["detail"]) for i in verify.whole_book(*x)]
    assert kinds(pages, outline, ["One", "Two", "One"], expected) == [("missing_body_content", None, "lost words"), ("empty_article_body", 3, "Two"), ("missing_image", None, "")]
    pages[2]["images"] = 1
    assert kinds(pages[1:], [], ["One"], expected | {"snippets": []}) == [("missing_toc", None, ""), ("toc_targets", None, "1/0")]


def test_books_of_all_pages(spark):
    got = {tuple(r) for r in plans.QUERIES["verify_books"](spark, SF).collect()}
    pages, want = read("pages"), set()
    for book, rows in pages.groupby(pages["page_id"] // 10):
        keeps = [k % 17 != 4 for k in rows["page_id"]]
        want |= {(book, "empty_article_body", k % 10 + 2, f"Article {k}") for k in rows["page_id"] if k % 17 == 4}
        want |= {(book, "missing_toc", None, "")} if book % 5 == 1 else set()
        want |= {(book, "toc_targets", None, f"{len(rows) - 1}/{len(rows)}")} if book % 7 == 2 else set()
        want |= set() if any(k and "<img" in h.lower() for k, h in zip(keeps, rows["html"], strict=True)) else {(book, "missing_image", None, "")}
        flat = lambda h: re.sub(r"\s", "", re.sub("<[^>]+>", "", h))
        for h in rows["html"]:
            m = re.search(r"(?i)<p[^>]*>([^<]*\w[^<]*)</p>", h)
            if m and not any(k and flat(m[1]) in flat(x) for k, x in zip(keeps, rows["html"], strict=True)):
                want.add((book, "missing_body_content", None, m[1]))
    assert got == want and {x[1] for x in got} >= {"empty_article_body", "missing_body_content", "missing_toc", "toc_targets"}


def test_running_means_across_blocks(spark, tmp_path):
    rows = [(k, f"s{(k % 7) // 3}", (k * 7919) % 5000 + (k % 2)) for k in range(6000)]
    spark.createDataFrame(rows[::-1], "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for _, s, x in rows:
        mean, n = want.get(s, (0.0, 0))
        want[s] = (float(int((mean * n + x) / (n + 1) + 0.5)), n + 1)
    got = plans.QUERIES["running_mean"](spark, str(tmp_path)).collect()
    assert {r["group"]: (r["mean"], r["n"]) for r in got} == want and len(got) == 3


def test_running_mean_rounds_each_step(spark):
    frames = [pd.DataFrame({"group": ["a", "a"], "value": [1.0, 2.0]}), pd.DataFrame({"group": ["a", "b"], "value": [2.0, 5.0]})]
    assert pd.concat(misc.fold_running_means(iter(frames))).values.tolist() == [["a", 2.0, 3], ["b", 5.0, 1]]


def test_responses_cover_segments_within_limits(spark):
    ship(spark)
    segments = spark.createDataFrame([(k, "a b c d", [(6, 7)]) for k in "pqrstuv"], "id string, text string, protected array<struct<start:int,end:int>>")
    note = lambda q, p="": (q, 1, p)
    given_ = {"p": [note("a"), note("b")], "q": [note("a"), note("b"), note("c")], "r": [note("a", "x"), note("b", "y")], "s": [note("d")], "t": [note("a b"), note("b")], "u": [note("z")], "w": []}
    rows = [*given_.items(), ("p", [note("a")])]
    answers = spark.createDataFrame(rows, "id string, annotations array<struct<quote:string,occurrence:int,prompt:string>>")
    got = sorted((r["id"], r["rule"]) for r in verify.response_issues(segments, answers, 2).collect())
    assert got == [("p", "repeated"), ("q", "density"), ("r", "prompts"), ("s", "protected"), ("t", "overlap"), ("u", "quote_missing"), ("v", "missing"), ("w", "extra")]
    kinds = spark.createDataFrame([("a", "idiom"), ("b", "odd"), ("c", None)], "id string, type string")
    assert sorted(r["id"] for r in verify.annotation_type_issues(kinds).collect()) == ["b", "c"]


def test_responses_of_all_pages(spark):
    rules = {}
    for r in plans.QUERIES["annotation_responses"](spark, SF).collect():
        rules.setdefault(r["rule"], set()).add(int(r["id"].split("/")[0]) % 9)
    one = {"density": {2}, "prompts": {3}, "quote_missing": {4}, "type": {5}, "repeated": {6}, "missing": {0, 1}, "extra": {1}}
    assert {k: rules.get(k) for k in one} == one


def test_dense_index_of_many_wide_rows(spark):
    n = 400_000
    rows = spark.range(n).selectExpr("id * 7 % 400009 * 3 AS raw_index", "repeat(md5(cast(id AS string)), 3) AS wide").repartition(7)
    out = frontier.dense_index(rows)
    assert out.columns == ["raw_index", "wide", "final_index"] and "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    found = out.selectExpr("count(*) AS n", "count(DISTINCT final_index) AS d", "min(final_index) AS a", "max(final_index) AS z", "count(DISTINCT wide) AS w").first()
    assert tuple(found) == (n, n, 0, n - 1, n)
    by_place = out.selectExpr("raw_index < lag(raw_index) OVER (ORDER BY final_index) AS wrong").where("wrong").count()
    assert by_place == 0
    assert frontier.dense_index(rows.where("false")).count() == 0


def test_dense_index_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (None, "d")], "raw_index int, url string")
    assert sorted(r["final_index"] for r in frontier.dense_index(rows).collect()) == [0, 1, 2, 3]


def test_start_pages_across_blocks(spark):
    rows = spark.range(2000).selectExpr("id % 2 AS book", "id AS index", "cast(id % 7 + 1 AS int) AS page_count").repartition(5)
    got = {r["index"]: r["start_page"] for r in book.start_pages(rows, block=37).collect()}
    want, at = {}, {0: 1, 1: 1}
    for k in range(2000):
        want[k] = at[k % 2]
        at[k % 2] += k % 7 + 1
    assert got == want

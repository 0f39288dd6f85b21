"""Whole runs, settings and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import misc, text, url
from quire.markdown.adapters import Adapter, Registry, drop_copy_residue
from quire.operators import batching, derive, frontier, run
from quire.session import ship
from quire.sources import config
from quire.streaming import status


def test_run(spark):
    ship(spark)
    html = "<html><head><title>{0} | Site</title></head><body><nav>n</nav><article><h1>{0}</h1><p>Copy</p><p>body {0}</p></article></body></html>"
    urls = ["https://e.org/a/", "https://e.org/a", "https://e.org/b?z=1&a=2", "https://e.org/gone", "https://x.org/c", "https://e.org/skip"]
    raw = spark.createDataFrame([(k, u, "s") for k, u in enumerate(urls)], "raw_index long, url string, section string")
    pages = spark.createDataFrame([("https://e.org/a", html.format("Alpha")), ("https://e.org/b?a=2&z=1", html.format("B"))], "url string, html string")
    adapters = Registry(Adapter("e", ("e.org",), None, [drop_copy_residue]))
    result = run.run(raw, pages, run.Settings(["e.org"], ignored=("skip",), adapters=adapters))
    assert [r["url"] for r in result.frontier.orderBy("final_index").collect()] == ["https://e.org/a/", "https://e.org/b?z=1&a=2", "https://e.org/gone"]
    assert [r["url"] for r in result.missing.collect()] == ["https://e.org/gone"]
    article = result.articles.orderBy("final_index").first()
    assert article["markdown"] == "---\ntitle: Alpha\nsource: https://e.org/a/\n---\n\n# Alpha\n\nbody Alpha"
    assert result.books.first()["markdown"].startswith("## Alpha\n\n") and result.books.first()["articles"] == 2
    again = run.run(raw, pages, run.Settings(["e.org"]), pages.select("url", F.sha2("html", 256).alias("sha256")))
    assert again.articles.count() == 0


def test_settings(tmp_path):
    assert config.validated({})[1] == []
    errors = config.validated({"concurrency": 20, "odd": 1, "markdown": {"enabled": False}, "annotations": {"enabled": True}}, {"translation": {"enabled": True}})[1]
    assert len(errors) == 5
    (tmp_path / "b.json").write_text('{"concurrency": 3}')
    (tmp_path / "a.json").write_text('{"concurrency": 2, "markdown": {"enabled": true}}')
    assert config.targets(str(tmp_path)) == ["a", "b"] and config.load(str(tmp_path / "a.json"), str(tmp_path / "b.json"))[0]["concurrency"] == 3


def test_stream(spark, tmp_path):
    ship(spark)
    rows = [(k % 5, ["success", "retrying", "failed"][k % 3], k) for k in range(60)]
    spark.createDataFrame(rows, "url long, status string, event_seq long").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url long, status string, event_seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    status.run_updates(status.latest(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = {r["url"]: (r["status"], r["event_seq"], r["retries"]) for r in status.settled(spark, f"file://{tmp_path}/out").collect()}
    assert got == {u: (max(r for r in ((x[2], x[1]) for x in rows if x[0] == u))[1], max(x[2] for x in rows if x[0] == u), sum(x[0] == u and x[1] == "retrying" for x in rows)) for u in range(5)}


def test_windows_and_duplicates(spark, tmp_path):
    ship(spark)
    rows = spark.range(100).select((F.col("id") % 4).alias("url"), F.lit("success").alias("status"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("url long, status string, ts timestamp").parquet(str(tmp_path / "in"))
    status.run_once(status.unique(stream()), f"file://{tmp_path}/u", f"file://{tmp_path}/us")
    assert spark.read.parquet(str(tmp_path / "u")).count() == 4
    status.run_once(status.counts(stream(), "10 minutes", "0 seconds"), f"file://{tmp_path}/c", f"file://{tmp_path}/cs")
    assert spark.read.parquet(str(tmp_path / "c")).agg(F.sum("count")).first()[0] >= 90


def test_derived_content_asks_once(spark):
    ship(spark)
    rows = spark.createDataFrame([("1", "a", "x"), ("2", "a", "x"), ("3", "b", "y"), ("4", "c", "z")], "id string, key string, text string")
    cache = spark.createDataFrame([("b", "B")], "key string, derived string")
    out = {r["id"]: (r["derived"], r["cached"]) for r in derive.derive(rows, cache, lambda b: {k: v + "!" for k, v in b.items() if v != "z"}).collect()}
    assert out == {"1": ("x!", False), "2": ("x!", False), "3": ("B", True), "4": (None, False)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_url_cases(spark):
    for given, want in {
        "HTTPS://A.org:443/B/?b=2&a=1&a=0#x": "https://a.org/B?a=1&a=0&b=2",
        "https://a.org": "https://a.org/",
        "https://a.org/?q": "https://a.org/?q=",
        "not a url": "not a url",
        "": "",
        "https://a.org/x//y": "https://a.org/x//y",
    }.items():
        assert one(spark, url.normalize(F.lit(given))) == want
        assert one(spark, url.normalize(url.normalize(F.lit(given)))) == want
    assert one(spark, url.in_scope(F.lit("ftp://a.org/"), ["a.org"])) is False and one(spark, url.in_scope(F.lit(None).cast("string"), ["a.org"])) is False
    assert one(spark, url.in_scope(F.lit("https://x.a.org/docs-old"), ["a.org"], "https://x.a.org/docs/")) is True
    assert one(spark, url.resolve(F.lit("../../x/./y?z"), F.lit("https://a.org/b/c/d"))) == "https://a.org/x/y?z"


def test_small_expressions(spark):
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"), F.lit(2))) == 3 and one(spark, text.occurrences(F.lit("a.b"), F.lit("."), F.lit(2))) is None
    assert one(spark, misc.running_mean_rounded(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)))) == 2.0
    assert one(spark, batching.greedy(F.array(*map(F.lit, [7000, 10, 5990, 5])))) == [0, 1, 1, 2]
    assert one(spark, text.cjk_emphasis(F.lit("_a_ b 漢_x_"))) == "_a_ b 漢*x*"
    assert 0 <= one(spark, misc.jittered(F.lit(100.0), F.lit(None).cast("double"), F.lit(1000.0), "equal", 3)) <= 100
    assert one(spark, frontier.entry_points(F.lit(" a "), F.array(F.lit("b"), F.lit("a"), F.lit("")))) == ["a", "b"]
    assert one(spark, misc.retry_after_ms(F.lit("Wed, 01 Jan 2020 00:00:10 GMT"), F.to_timestamp(F.lit("2020-01-01 00:00:00")))) == 10_000.0

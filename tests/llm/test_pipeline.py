"""The pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import pytest

import corpus_pipeline
from quire.llm import queries
from tests.llm.test_edges import plain_components, plain_fingerprint, plain_substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_stages_return_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_language_stage_keeps_what_has_letters(stages):
    before, after = stages[0]
    want = {r["doc_id"] for r in before.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in after.collect()} == want


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = stages[1]
    label = plain_components({r["doc_id"]: plain_fingerprint(r["text"]) for r in before.collect()}, 3)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(label.values()))


def test_substring_stage_cuts_repeats(stages):
    import hashlib

    before, after = stages[2]
    want = {d: h for d, _, _, h in plain_substrings([(r["doc_id"], r["text"]) for r in before.collect()], 50)}
    got = {r["doc_id"]: hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() for r in after.collect()}
    assert got == want


def test_mix_stage_repeats_whole_rows(stages):
    before, after = stages[3]
    rows = {r["doc_id"]: tuple(r) for r in before.collect()}
    assert after.count() and all(rows[r["doc_id"]] == tuple(r) for r in after.collect())


def test_packing_stage_holds_every_copy(stages):
    before, after = stages[4]
    whole = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(n == 1024 or n & (n - 1) == 0 for _, n in whole)
    starts = after.where("start = 0").count()
    assert starts == before.count()


def test_run_and_messy_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    odd = spark.createDataFrame([(None, "text here", None, None, None), (1, None, "en", "s", 0), (1, "x y", "en", "s", 3), (1, "x y", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    docs.collect()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), SF).count() == 0


def test_stages_keep_clashing_columns_and_long_texts(spark):
    """Extra columns with the operators' own names, repeated and clashing rows, nulls, and a very long text."""
    long_text = " ".join(f"word{k % 977} of the passage" for k in range(40_000))
    extra = "n_words long, kept string, component_id long, lang_pred string, score double, copy_no string, mix_key string, key long, runs string, tags map<string,string>"
    rows = [(1, "der erste text", "de", "src0"), (1, "another text", "en", "src0"), (1, "another text", "en", "src0"), (2, long_text, "en", None), (3, None, "en", "s"), (4, "", None, "s"), (None, "no key here", "en", "s"), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, k, -k, "K", 7, "und", 0.5, "c", "m", 9, "r", {"a": str(k)}) for k, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.schema == before.schema, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r["kept"] for r in docs.collect()} == {"K"}
        if name == "language_id":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "1", "2", "None"]
        if name == "near_duplicates":
            assert sorted((str(r["doc_id"]), r["text"][:7]) for r in docs.collect()) == [("1", "another"), ("2", "word0 o"), ("None", "no key ")]
            assert [r["tags"] for r in docs.where("doc_id = 1").collect()] == [{"a": "1"}]
    assert corpus_pipeline.pack(spark, docs, SF).count() > 0


def test_every_query_is_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))

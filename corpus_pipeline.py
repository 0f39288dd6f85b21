"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, mixing, packing, simhash, substrings
from quire.storage import Scratch
from quire.llm.queries import MIX_OTHER, MIX_WEIGHTS, table, tokenizer_file
from quire.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def aside(docs: DataFrame, names: set[str]) -> DataFrame:
    """Columns that an operator would replace by its own, under other names."""
    return docs.select(*[F.col(c).alias(f"__{c}" if c in names else c) for c in docs.columns])


def back(docs: DataFrame, columns: list[str], names: set[str]) -> DataFrame:
    return docs.select(*[F.col(f"__{c}" if c in names else c).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found: those without a letter go, null and empty texts too.

    Other columns, repeated rows, null keys and labels pass unchanged; input columns named like the operator's results are
    kept as they are. Without any labelled row nothing is learned and every document goes.
    """
    ship(spark)
    own = {"held_out", "lang_pred", "score"}
    marks = langid.identify_languages(aside(docs, own), carry=True)
    return back(marks.where("lang_pred <> 'und'"), docs.columns, own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group the document with the smallest doc_id, once; rows with a null doc_id belong to no group and stay.

    Null and empty texts are one group. Rows of one doc_id are one document, whatever else they hold: the one with the
    smallest text stays, null first, then by all its columns as JSON.
    """
    ship(spark)
    kept = simhash.near_duplicates(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__n"))
    named = Scratch(spark).put(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id").join(kept, "doc_id"), "kept")
    first = F.min_by("__row", F.struct("__row.text", F.to_json("__row")))
    again = named.where("__n > 1").groupBy("doc_id").agg(first.alias("__row"))
    alone = named.where("__n = 1").select("__row").unionByName(again.select("__row"))
    return alone.select("__row.*").unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller doc_id has; n_chars follows the text, every document stays.

    A text of which nothing is left is empty. Null texts and rows with a null doc_id pass unchanged, rows of one doc_id
    take nothing from each other; input columns named like the operator's results are kept as they are.
    """
    ship(spark)
    own = {"n_words", "n_removed", "kept_sha256", "kept_text"}
    cut = substrings.remove_repeats(aside(docs, own))
    cut = cut.withColumns({"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))})
    return back(cut, docs.columns, own)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the target shares of their sources, in random order.

    Null texts count as no characters; null sources are the others; a source without characters gets no copies. Copies of
    a document are equal rows. Other columns pass unchanged.
    """
    own = {"copy_no", "mix_key"}
    return back(mixing.mix_sources(aside(docs, own), MIX_WEIGHTS, MIX_OTHER), docs.columns, own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 token ids. Copies are documents of their own; null text: the end id alone."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Fingerprints and graphs are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder, so none runs twice."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs

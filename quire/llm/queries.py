"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import embedding_graph, langid, mixing, packing, quality, simhash, substrings, token_counts, token_files, url_filters
from quire.session import ship

MIX_WEIGHTS = {"src0": 0.10, "src1": 0.10, "src2": 0.15, "src3": 0.15}
MIX_OTHER = 0.5
TOKEN_LIMIT = 4096
URL_PREFIXES = [
    url_filters.Prefix("allow", "org", "/"),
    url_filters.Prefix("block", "example.org", "/es/"),
    url_filters.Prefix("block", "example.org", "/en/1"),
    url_filters.Prefix("allow", "com", "/fr/"),
    url_filters.Prefix("block", "com", "/de/"),
]
#: Words that stand whole in hosts or paths of unwanted pages, by kind, and those that name query parameters of paid clicks.
URL_WORDS = {
    "ad": "adform admob adnxs adroll ads adserver adservice adsystem adtech banner banners criteo doubleclick outbrain popads popunder sponsor taboola",
    "adult": "adult camgirls escort escorts hentai porn sexcams xxx",
    "gambling": "baccarat bets betting bingo casino jackpot lottery poker roulette slots sportsbook",
    "loans": "loans payday quickcash titleloan",
    "pills": "cialis pharmacy pills viagra xanax",
    "replica": "fakewatches knockoff replica replicas",
    "spam": "doorway linkfarm paidlinks spam splog",
    "tracker": "analytics beacon clickstat hitcounter pixel statcounter telemetry tracker tracking",
    "warez": "crack cracked keygen nulled torrent torrents warez",
}
CLICK_WORDS = "dclid fbclid gclid igshid mc_eid msclkid ttclid twclid wbraid yclid"
URL_PATTERNS = [
    url_filters.pattern(name, regex)
    for name, regex in sorted(
        {f"{kind}_{word}_{place}": form.format(word) for kind, words in URL_WORDS.items() for word in words.split() for place, form in (("host", "[/.]{}[.-]"), ("path", "/{}/"))}.items()
        | {f"click_{word}": f"[?&]{word}=" for word in CLICK_WORDS.split()}.items()
        | {
            "ad_size": r"/[a-z]+-[0-9]+x[0-9]+/ads/",
            "ad_tracks": r"[/.]ads-track[a-z]*\.",
            "cgi": "/cgi-bin/",
            "free_bets": r"[/.]free-bets\.",
            "ip_host": r"://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[/:]",
            "login": r"/(wp-login|administrator|user/login)\.php",
            "paid_click": "[?&]utm_medium=(cpc|ppc|paid)[&#]",
            "pixel_image": r"/(pixel|spacer|blank)\.(gif|png)",
            "xxx_top": r"\.xxx/",
        }.items()
    )
]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_OTHER)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), TOKEN_LIMIT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_PREFIXES, URL_PATTERNS)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_substring_dedup, op3_simhash_duplicates, op4_vector_packing, op5_token_files, op6_quality_cascade, op7_embedding_graph, op8_url_filters, op9_language_id, op10_token_counts)
}

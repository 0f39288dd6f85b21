"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns,
against plain versions of what it promises."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import embedding_graph, langid, mixing, packing, quality, simhash, substrings, token_counts, token_files, url_filters
from quire.llm.queries import URL_PATTERNS, URL_PREFIXES, tokenizer_file
from quire.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, copy_no string, score string, fingerprint string"


def messy_texts() -> list[str | None]:
    rng = random.Random(4)
    words = ["the", "of", "Über", "élan", "x", "done.", "a,b", "$$$", "12", "日本"]
    prose = " ".join(rng.choices(words, k=120))
    passage = " ".join(f"w{k}" for k in range(60))
    long_text = " ".join(rng.choices(words, k=30_000))
    return [prose, prose, prose + " more", passage, "lead in " + passage + " tail", None, "", " \t\n ", "x", "x y", "A  b\n\n c ", " a", "a\nb \n", long_text, "the " * 400, "\u00a0", "<|endoftext|> </s>", "▁ a", "same line\n" * 30, "\x1c\x85é"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    texts = messy_texts()
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None, 7, "x", "y", "z") for k, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_mixing(docs, none):
    assert mixing.mix_sources(none, {"s0": 1.0}).count() == 0
    out = mixing.mix_sources(docs, {"s0": 0.5, "s1": 0.25}, 0.25, epochs=3.0)
    rows = out.collect()
    assert {"mix_key", "copy_no", "text", "score"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(1), {"s0": 0.5, "s1": 0.25}, 0.25, epochs=3.0).collect()))
    assert mixing.mix_sources(docs, {"s0": 1.0}, 0.0).where("source <> 's0' or source is null").count() == 0


def test_mixing_hits_its_weights(spark):
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix_sources(big, {"hot": 0.2}, 0.8, epochs=60.0).groupBy("source").count().collect()}
    assert abs(counts["hot"] / sum(counts.values()) - 0.2) < 0.005 and abs(sum(counts.values()) / 1_200_000 - 1) < 0.01


def test_poisson_cdf_ends_near_one():
    for mean in (0.01, 1.0, 15.9):
        cdf = mixing.poisson_cdf(mean)
        assert cdf == sorted(cdf) and cdf[-1] > 1 - 1e-12


def plain_substrings(rows, width):
    first = {}
    for d, t in sorted(x for x in rows if x[0] is not None and x[1] is not None):
        w = t.encode().split()
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if d is not None and first[tuple(w[k : k + width])] < d:
                gone |= set(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1000, 2])
def test_substrings(docs, none, most):
    assert substrings.remove_repeats(none).count() == 0
    out = substrings.remove_repeats(docs, most=most, shard_words=500)
    assert out.columns.count("n_words") == 1 and "score" in out.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted([tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str) == plain_substrings(rows, 50)
    assert out.where("n_removed = 0 and not (kept_text <=> text)").count() == 0


def test_substrings_of_equal_rows_and_hot_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    passage, line = " ".join(word() for _ in range(70)), " ".join(word() for _ in range(25))
    rows = [(7, f"same {passage} row")] * 40
    rows += [(100 + k, " ".join([*(word() for _ in range(30)), passage, *(word() for _ in range(30))])) for k in range(30)]
    rows += [(200 + k, " ".join([*(word() for _ in range(40)), line, *(word() for _ in range(40))])) for k in range(30)]
    rows += [(300 + k, rows[40 + 30 + k][1].replace(" a", " a" if k % 2 else " x", 1)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (512, 4):
        got = substrings.remove_repeats(docs, most=most, shard_words=900).drop("text", "kept_text").collect()
        assert sorted(map(tuple, got), key=str) == plain_substrings(rows, 50)


def thue_morse(n: int) -> tuple[str, str]:
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_words_that_weak_hashes_confuse(spark):
    x, y = thue_morse(11)
    rows = [(1, " ".join([x, *(f"w{k}" for k in range(60))])), (2, " ".join([y, *(f"w{k}" for k in range(49))])), (3, " ".join([*[x, y] * 30])), (4, " ".join([*[y, x] * 30]))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("text", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == plain_substrings(rows, 50)


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_words_of_one_hash_keep_their_ids(monkeypatch, bits):
    from quire.llm import tokens, windows, wordhash

    x, y = thue_morse(10)
    texts = ["x", f"q {x}", f"q {y}", "one two three", "three two one one", "a\nb c\nd", "", "aa bb " * 20, "a word of over sixteen bytes: incomprehensibilities incomprehensibilitiez"]
    monkeypatch.setattr(wordhash, "mix", lambda h: h & np.uint64(2**bits - 1))
    encoder = tokens.WordTokens(tokenizer_file("byte_bpe_50k.json"))
    plain = library("byte_bpe_50k.json")
    for _ in range(2):
        ids, counts = encoder.encode([t.encode() for t in texts])
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    numbers = windows.Words.of([t.encode() for t in ("a b c a", f"{x} {y} {x}")]).numbers().tolist()
    assert numbers[0] == numbers[3] and numbers[4] == numbers[6] and len(set(numbers)) == 5


def plain_fingerprint(text, width=3):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < width else [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps: dict[int, int], distance: int) -> dict[int, int]:
    label = {f: i for i, f in sorted(((i, f) for i, f in fps.items()), reverse=True)}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("most", [1024, 2])
def test_simhash(docs, none, most):
    assert simhash.near_duplicates(none).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    label = plain_components({d: plain_fingerprint(t) for d, t in rows if d is not None}, 3)
    want = sorted([(d, f"{plain_fingerprint(t):016x}", label[plain_fingerprint(t)] if d is not None else None) for d, t in rows], key=str)
    assert sorted([tuple(r) for r in simhash.near_duplicates(docs, most=most).collect()], key=str) == want


def test_simhash_links_chains(spark):
    rng = np.random.default_rng(1)
    fp, values = 0, []
    for k in range(60):
        values.append((k, fp))
        for b in rng.choice(64, 3, replace=False):
            fp ^= 1 << int(b)
    from quire.storage import Scratch
    from quire.llm.components import connected_components

    scratch = Scratch(spark)
    items = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in values], "fp long, rep long")
    found = scratch.put(simhash.links(simhash.candidate_groups(items, 3, 4, scratch), 3), "links")
    assert {r["component"] for r in connected_components(found, scratch).collect()} == {0}


def library(file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(file))


def test_packing(docs, none):
    file = tokenizer_file("byte_bpe_50k.json")
    assert packing.pack_documents(none, file).count() == 0
    encoder = library("byte_bpe_50k.json")
    want = sorted((str(r["doc_id"]), len(ids := encoder.encode(r["text"] or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in docs.collect())
    rows = packing.pack_documents(docs, file, with_ids=True, pool=4).collect()
    bins, whole = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) > 0
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        whole.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert sum(len(p[1]) for v in whole.values() for p in v) == sum(n for _, n, _ in want)


def test_packing_of_conversations(spark):
    """Three different demands: all limits hold in every sequence, each binds in some, and no id is lost."""
    ship(spark)
    rng, file = random.Random(8), tokenizer_file("byte_bpe_50k.json")
    say = lambda n: " ".join(rng.choices(["the", "of", "done.", "quiet", "12"], k=n))
    rows = [(k, [(say(rng.choice([1, 3, 200])), False), (say(rng.choice([1, 40, 900])), True)] * rng.choice([0, 1, 3])) for k in range(120)]
    rows += [(200, None), (201, [(None, True), ("", None), ("x", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, turns array<struct<text:string,loss:boolean>>").repartition(2)
    limits = packing.Limits(256, 6, 160)
    out = packing.pack_documents(docs, file, limits, with_ids=True, pool=50, parts="turns").collect()
    encoder = library("byte_bpe_50k.json")
    want = {}
    for k, turns in rows:
        ids, bears = [], []
        for t, loss in turns or []:
            own = encoder.encode(t or "", add_special_tokens=False).ids
            ids, bears = ids + own, bears + [bool(loss)] * len(own)
        want[k] = (ids + [0], bears + bears[-1:] or [False])
    bins = {}
    for r in out:
        ids, bears = want[r["doc_id"]]
        assert r["ids"] == ids[r["start"] : r["start"] + r["length"]] and r["loss_tokens"] == sum(bears[r["start"] : r["start"] + r["length"]])
        bins.setdefault(r["sequence_id"], []).append((r["length"], r["loss_tokens"]))
    assert sum(r["length"] for r in out) == sum(len(v[0]) for v in want.values())
    full = [(sum(n for n, _ in b), len(b), sum(w for _, w in b)) for b in bins.values()]
    assert all(n <= 256 and k <= 6 and w <= 160 for n, k, w in full)
    assert any(n == 256 for n, _, _ in full) and any(w == 160 for _, _, w in full) and any(k == 6 for _, k, _ in full)


def test_vector_packing_keeps_all_limits():
    rng = random.Random(2)
    tokens = [rng.randint(1, 900) for _ in range(400)]
    loss = [rng.randint(0, t) for t in tokens]
    limits = packing.Limits(1024, 4, 500)
    loss = [min(x, 500) for x in loss]
    bins, left = packing.VectorPacker(limits, False).pack(tokens, loss, True)
    assert not left and sorted(i for b in bins for i, _, _ in b) == list(range(400))
    for b in bins:
        assert len(b) <= 4 and sum(n for _, _, n in b) <= 1024 and sum(loss[i] for i, _, _ in b) <= 500
    assert len(bins) < 1.35 * max(sum(tokens) / 1024, sum(loss) / 500)


def test_token_files(docs, none, tmp_path):
    file = tokenizer_file("byte_bpe_50k.json")
    assert token_files.token_file_round_trip(none, file).count() == 0
    encoder, at, want = library("byte_bpe_50k.json"), 0, []
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()), key=str)
    lengths = [len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in [(None, None), (None, messy_texts()[0])]]
    at = sum(lengths)
    for d, t in sorted(rows, key=lambda x: x[0]):
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = token_files.token_file_round_trip(docs, file, length=64)
    assert sorted(tuple(r) for r in out.where("doc_id is not null").collect()) == want and out.count() == docs.count()
    import pyarrow as pa

    writer = token_files.SequenceWriter(f"file://{tmp_path}/x.arrow", 4, pa.uint16(), rows=2)
    writer.append(np.arange(11))
    writer.close()
    ids, mask = token_files.SequenceReader(f"file://{tmp_path}/x.arrow").sequence(2)
    assert ids.tolist() == [8, 9, 10, 0] and mask.to_pylist() == [True, True, True, False]


def plain_quality(text):
    w = (text or "").encode().split()
    repeat = set()
    places = {}
    for k in range(len(w) - 7):
        places.setdefault(tuple(w[k : k + 8]), []).append(k)
    for at in places.values():
        if len(at) > 1:
            repeat |= {k + i for k in at for i in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat)


def test_url_rules_by_plan_and_by_table(spark):
    """Rules with alternatives, groups and no token; long lists; very long urls; rules of equal length; ties of tokens."""
    import re

    rng = random.Random(11)
    words = ["ads", "casino", "x1", "pixel", "track", "en", "q"]
    urls = [f"http://{rng.choice(words)}{rng.choice('.-')}{rng.choice(words)}.{rng.choice(['org', 'com'])}/{rng.choice(words)}{rng.choice('/-=.')}{rng.choice(words)}" for _ in range(300)]
    urls += [None, "", "no scheme /ads/", "HTTP://ADS.X1.ORG/Casino/", "http://a.org/" + "ads/" * 30_000, "http://a.org/" + "z" * 100_000, urls[0], urls[0]]
    patterns = [url_filters.pattern(n, r) for n, r in {"a": "[/.]ads[./]", "b": "/(casino|pixel)/", "c": "track-q|x1=en", "d": r"\.com/en[/-]", "e": "[?&]none=", "f": "z{50}"}.items()]
    prefixes = [url_filters.Prefix("allow", "org", "/a"), url_filters.Prefix("block", "x1.org", ""), url_filters.Prefix("allow", "q.com", "/en"), url_filters.Prefix("block", "com", "/en/q")]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, pattern string").repartition(3)
    want = {k: min((p.name for p in patterns if re.search(p.regex, (u or "").lower())), default=None) for k, u in enumerate(urls)}
    assert set(want.values()) >= {"a", "b", "c", "d", "f", None}
    by_plan = url_filters.filter_urls(pages, prefixes, patterns).collect()
    by_table = url_filters.filter_urls(pages, prefixes, patterns, most=2).collect()
    assert sorted(map(str, by_plan)) == sorted(map(str, by_table)) and {r["page_id"]: r["pattern"] for r in by_plan} == want
    for r in by_plan:
        fits = [p for p in prefixes if (r["host"] == p.host or r["host"].endswith("." + p.host)) and r["path"].startswith(p.path)]
        longest = max(fits, key=lambda p: len(p.host + p.path), default=None)
        assert (r["rule"], r["verdict"]) == ((longest.host + longest.path, longest.verdict) if longest else (None, "block" if r["pattern"] else "allow"))
    assert url_filters.filter_urls(pages.where("false"), prefixes, patterns, most=2).count() == 0
    assert url_filters.filter_urls(pages, prefixes, []).where("pattern is not null").count() == 0


@pytest.mark.parametrize("name", ["op1_mix_sources", "op6_quality_cascade", "op8_url_filters"])
def test_rows_are_those_of_the_sql(spark, name):
    import duckdb

    from quire.llm import oracle, queries
    from tests.test_queries import SF, TABLES, rows_of

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(oracle.ORACLE_SQL[name]).fetchdf())


def test_quality(docs, none):
    assert quality.quality(none).count() == 0
    out = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality(docs).collect()}
    want = set()
    for r in docs.collect():
        c = plain_quality(r["text"])
        want.add((r["doc_id"], *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert out == want


def test_embeddings(spark):
    ship(spark)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 16))
    near = base[:40] + 0.02 * rng.normal(size=(40, 16))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([base, near, base[:5]]))]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [1.0] * 15 + [float("nan")]), (1003, [1.0, 2.0]), (1004, [None] * 16), (1005, [float("inf")] * 16), (None, rows[0][1]), rows[3]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    out = embedding_graph.near_duplicate_vectors(df, shard_rows=60).collect()
    assert len(out) == df.count()
    good = rows + [rows[3]]
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in out}
    assert sum(got[k] for k, _ in rows) >= 0.98 * links[: len(rows)].sum() and all(got[k] <= links[i] for i, (k, _) in enumerate(rows))
    for r in out:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None and not r["kept"]
        elif r["vec_id"] >= 1000:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"]
    by = {r["vec_id"]: r["component_id"] for r in out}
    assert sum(by[300 + k] == k for k in range(40)) >= 39 and by[340] == 0
    assert embedding_graph.near_duplicate_vectors(df.where("false")).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTPS://A.Example.ORG/es/x?y#z", "http://example.org", "https://m.casino-win.test/en/4", "https://x.com/de/1", "https://x.com/fr/casino-a.b", "a://b://c/d", "https://s.test/a?gclid=1"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string")
    out = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in url_filters.filter_urls(df, URL_PREFIXES, URL_PATTERNS).collect()}
    assert (0, "", "", None, "allow", None) in out and (4, "example.org", "", None, "allow", None) in out
    assert (3, "a.example.org", "/es/x", "example.org/es/", "block", None) in out and (5, "m.casino-win.test", "/en/4", None, "block", "gambling_casino_host") in out
    assert (6, "x.com", "/de/1", "com/de/", "block", None) in out and (7, "x.com", "/fr/casino-a.b", "com/fr/", "allow", "gambling_casino_host") in out
    assert len(out) == df.count() and url_filters.filter_urls(df.where("false"), URL_PREFIXES, URL_PATTERNS).count() == 0


def test_every_pattern_has_its_tokens_in_every_match():
    import re

    samples = ["https://ads-track.x/", "https://a.free-bets.b/c", "http://q/cgi-bin/x", "https://s.test/a?gclid=1", "https://u.v/wp-login.php", "http://payday-loans.a/", "http://x.y/pixel.gif?z", "https://a.xxx/"]
    for p in URL_PATTERNS:
        for s in samples:
            if re.search(p.regex, s):
                assert set(p.words) <= set(re.findall("[a-z0-9]+", s))
    assert url_filters.pattern("loose", "casino.*").words == ()


def plain_links(rows: dict[int, list[float]], least: float = 0.95) -> dict[int, set[int]]:
    out = {}
    for k, v in rows.items():
        out[k] = set()
        for j, w in rows.items():
            if j != k and len(v) == len(w):
                a, b = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    out[k].add(j)
    return out


def test_embeddings_of_any_size_and_length(spark):
    """Components beyond the square root of the largest number, several lengths, close groups, links far from the sample."""
    ship(spark)
    rng = np.random.default_rng(5)
    rows = {0: [1e200] * 8, 1: [1e200] * 7 + [1.01e200], 2: [1e-200] * 8, 3: [1.0, 2.0], 4: [1.0, 2.1], 5: [3.0], 6: [5.0], 7: [-1.0]}
    base = rng.normal(size=(400, 8))
    for k, v in enumerate(np.concatenate([base, base[:60] + 0.01 * rng.normal(size=(60, 8)), 3.0 + 0.001 * rng.normal(size=(150, 8))])):
        rows[10 + k] = v.tolist()
    out = embedding_graph.near_duplicate_vectors(spark.createDataFrame([*rows.items(), (900, [])], "vec_id long, embedding array<double>"), shard_rows=40)
    want, got = plain_links(rows), {r["vec_id"]: r for r in out.collect()}
    assert len(got) == len(rows) + 1 and got[900]["n_links"] == 0
    assert all(got[k]["n_links"] <= len(v) for k, v in want.items())
    shares = [got[k]["n_links"] / len(v) for k, v in want.items() if v]
    assert np.mean(shares) > 0.98 and [got[k]["n_links"] > 0 for k in range(8)] == [True] * 7 + [False]
    assert got[1]["component_id"] == 0 == got[2]["component_id"] and got[4]["component_id"] == 3 and got[6]["component_id"] == 5


def test_embeddings_below_the_lowest_recall_are_an_error(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(embedding_graph, "audit", lambda *_: 0.5)
    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        embedding_graph.near_duplicate_vectors(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 700])
def test_graph_search_finds_what_is_in_range(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 12))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.normal(size=(n - n // 2, 12))
    x = embedding_graph.unit(x)
    graph = embedding_graph.build_graph(x)
    _, who, found = embedding_graph.greedy(x, graph, x, np.zeros((n, 1), int), min(32, n), 0.95)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True)}
    got = list(zip(who.tolist(), found.tolist(), strict=True))
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want)


def test_languages(docs, none, spark):
    assert langid.identify_languages(none).count() == 0
    out = langid.identify_languages(docs, carry=True)
    assert out.columns.count("score") == 1 and out.count() == docs.count()
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify_languages(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() / found.count() > 0.97


def plain_vector(text: str, letters: np.ndarray) -> np.ndarray:
    out = np.zeros(langid.DIMENSIONS)
    for code in langid.trigrams(text)[0].tolist():
        a, b, c = code // 4096, code // 64 % 64, code % 64
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_languages_are_those_of_explicit_vectors(spark):
    """Many more languages than a task holds at once, ties, and texts of one trigram."""
    ship(spark)
    rng, letters = random.Random(3), langid.letter_vectors()
    say = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß "[k % 20 :], k=rng.choice([1, 30, 400])))
    rows = [(k, say(k % 50), f"l{k % 50:02d}") for k in range(300)] + [(300, "x", None), (301, "日本語", "l00"), (302, None, "l01")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    sums: dict[str, np.ndarray] = {}
    for k, t, name in rows:
        if not held(k) and t is not None and name:
            sums[name] = sums.get(name, 0) + plain_vector(t, letters)
    names = sorted(sums)
    unit = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    got = {r["doc_id"]: r for r in langid.identify_languages(docs).collect()}
    for k, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        v = plain_vector(t, letters)
        cosine = unit @ v / np.linalg.norm(v)
        assert abs(got[k]["score"] - max(0, cosine.max())) < 1e-4 and cosine[names.index(got[k]["lang_pred"])] > cosine.max() - 1e-4


def test_token_counts(docs, none):
    import sentencepiece

    file = tokenizer_file("piece_bpe_32k.model")
    assert token_counts.count_tokens(none, file, 5).count() == 0
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    want = sorted([(r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 5) for r in docs.collect()], key=str)
    assert sorted([tuple(r) for r in token_counts.count_tokens(docs, file, 5).collect()], key=str) == want


def test_tokenizers_word_by_word_equal_whole_texts():
    from quire.llm.tokens import WordTokens

    rng = random.Random(1)
    signs = ["a", "b", " ", "\n", ".", ",", "'s", "the", "é", "日", "1", "\t", "\xa0", "!", "▁", "<|endoftext|>"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(3000)]
    words = WordTokens(tokenizer_file("byte_bpe_50k.json"))
    ids, counts = words.encode([t.encode() for t in texts])
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [x.ids for x in words.library.encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.PieceCounter(tokenizer_file("piece_bpe_32k.model"))
    assert counter.count(texts) == [len(x) for x in counter.model.encode(texts)]

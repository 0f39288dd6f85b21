"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import long_hash, unit_hash

#: A Poisson draw of a larger mean is the sum of draws of at most this mean, so that exp(-mean) never underflows.
STEP = 16.0


def poisson_cdf(mean: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until no double below one lies above."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while True:
        total += term
        if total >= 1.0 or (k > mean and term < 2.0**-60):
            return out
        out.append(total)
        k += 1
        term *= mean / k


def poisson_count(mean: float, seed: str, key: Column) -> Column:
    """Inverse of the Poisson distribution at hash-seeded points of [0, 1)."""
    if mean <= 0:
        return F.lit(0)
    parts = math.ceil(mean / STEP)
    cdf = F.array(*[F.lit(x) for x in poisson_cdf(mean / parts)])

    def draw(part: Column) -> Column:
        u = F.array(unit_hash(seed, "count", part, key))  # in an array: the hash is taken once, not for each threshold
        return F.element_at(F.transform(u, lambda x: F.size(F.filter(cdf, lambda c: c <= x))), 1)

    if parts == 1:
        return draw(F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), lambda n, part: n + draw(part))


def repetition_rates(docs: DataFrame, weights: dict[str, float], other: float, epochs: float, source: str, text: str) -> dict[str | None, float]:
    """Mean repetitions of a document by source; None: of each source without a weight of its own.

    Sources without a weight are summed as one, so the driver gets at most one row for each weight given and one more.
    """
    named = F.when(F.col(source).isin(list(weights)), F.col(source)) if weights else F.lit(None).cast("string")
    rows = docs.groupBy(named.alias("s")).agg(F.sum(F.length(text)).alias("n")).collect()
    sizes = {r["s"]: r["n"] or 0 for r in rows}
    total, shares = float(sum(sizes.values())), {**weights, None: other}
    whole = sum(shares.values())
    return {s: share / whole * epochs * total / sizes[s] if sizes.get(s) else 0.0 for s, share in shares.items()}


def mix_sources(docs: DataFrame, weights: dict[str, float], other: float = 0.0, epochs: float = 1.0, seed: str = "mix", source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Repeat documents so that each source makes up its target share of the characters, and shuffle all copies.

    ``weights``: target share by source; ``other``: the share of all other sources together, null included, each of them
    in proportion to its size. Shares are divided by their sum. ``epochs``: size of the mix over the size of the input.
    A document of a source with mean rate r is repeated k times, k being the inverse of the Poisson(r) distribution at a
    hash of (seed, key): the same on every run and after a lost executor. Copies are dealt to partitions by a hash and
    sorted by it within each, so read in file order they come in a random order over all sources.

    Returns all columns of ``docs`` and ``copy_no`` (from 0) and ``mix_key`` (the shuffle's hash); input columns of these
    names are replaced. One pass for sizes, one shuffle of the copies; rates enter the plan as constants, so no source is
    a join or group key and none can be hot.

    Null text: counts as no characters; the row is repeated like the others of its source. A source whose texts are all
    null or empty has no size to scale and gets no copies. Null key: hashed as "null". Repeated rows: equal keys get equal
    counts, each row is repeated by itself. Empty table: empty result.
    """
    rates = repetition_rates(docs, weights, other, epochs, source, text)
    count = poisson_count(rates.pop(None), seed, F.col(key))
    for name, rate in rates.items():
        count = F.when(F.col(source) == name, poisson_count(rate, seed, F.col(key))).otherwise(count)
    columns = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    copies = docs.select(*columns, F.posexplode(F.array_repeat(F.lit(0), count)).alias("copy_no", "__one")).drop("__one")
    mixed = copies.withColumn("mix_key", long_hash(seed, "order", F.col(key), F.col("copy_no")))
    return mixed.repartition("mix_key").sortWithinPartitions("mix_key", key)

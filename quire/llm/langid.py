"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices

#: Symbols: 0 a gap between words, 1-26 a-z, 27-63 all other letters, dealt by code point.
SYMBOLS = 64
DIMENSIONS = 1024


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        if chr(code).isalpha():
            table[code] = code - 96 if 97 <= code <= 122 else 27 + code * 2654435761 % 2**32 % 37
    return table


_TABLE: list[np.ndarray] = []


def trigrams(text: str) -> tuple[np.ndarray, int]:
    """Codes of the letter trigrams of a text, gaps between words included; number of letters."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _TABLE[0][np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        symbols[high] = [27 + int(c) % 37 if chr(c).isalpha() else 0 for c in codes[high]]
    symbols = np.concatenate([[0], symbols, [0]]).astype(np.int32)
    symbols = symbols[np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]]  # one gap, however long
    return (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], int(np.count_nonzero(symbols))


def letter_vectors(seed: int = 7) -> np.ndarray:
    """A random vector of -1 and 1 for each symbol."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))


def trigram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A trigram's vector binds (multiplies) its first letter's vector permuted twice, its second's permuted once, and its
    third's."""
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def bundle(texts: list[np.ndarray], letters: np.ndarray, step: int = 2048) -> np.ndarray:
    """For each array of trigram codes the sum of their vectors, as often as they stand there."""
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes, number = np.unique(np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64), return_inverse=True)
    pairs, many = np.unique(number.astype(np.int64) * max(1, len(texts)) + rows, return_counts=True)  # by code, then text
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    cuts = np.searchsorted(pairs, np.arange(0, len(codes) + step, step) * max(1, len(texts)))
    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        counts = np.zeros((len(texts), min(step, len(codes) - k * step)), np.float32)
        counts[pairs[x:y] % len(texts), pairs[x:y] // len(texts) - k * step] = many[x:y]
        out += counts @ trigram_vectors(codes[k * step : (k + 1) * step], letters)
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", held: int = 32) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes: the bundle of all trigrams of all their texts.

    Tasks count the trigrams of up to ``held`` languages at once and emit their bundles, DIMENSIONS numbers a language;
    these are summed by (language, place), so the driver gets DIMENSIONS rows a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        letters = letter_vectors()

        def bundled() -> Iterator[pa.RecordBatch]:
            for name, n in counts.items():
                codes, total = np.flatnonzero(n), np.zeros(DIMENSIONS)
                for at in range(0, len(codes), 2048):
                    part = codes[at : at + 2048]
                    total += n[part].astype(np.float64) @ trigram_vectors(part, letters).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], names=["lang", "place", "x"])
            counts.clear()

        for batch in slices(batches):
            codes: dict[str, list[np.ndarray]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes.setdefault(name, []).append(trigrams(t)[0])
            for name, found in codes.items():
                if name not in counts and len(counts) >= held:
                    yield from bundled()
                n = np.bincount(np.concatenate(found), minlength=SYMBOLS**3)
                counts[name] = counts[name] + n if name in counts else n
        yield from bundled()

    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    sums = known.mapInArrow(run, "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x")).toArrow()
    names = sorted(set(sums["lang"].to_pylist()))
    prototypes, row = np.zeros((len(names), DIMENSIONS)), {name: k for k, name in enumerate(names)}
    prototypes[[row[x] for x in sums["lang"].to_pylist()], sums["place"].to_numpy()] = sums["x"].to_numpy()
    return names, prototypes


def held_out(key: str) -> Column:
    """True for a third of the rows, by the CRC-32 of the key as text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """Per row: key (with ``carry`` all input columns), held_out, lang_pred, score. Only the text decides.

    Letters have random vectors of -1 and 1; a trigram's vector is the product of its letters' vectors, permuted by their
    place; a document's vector is the sum over its trigrams, a language's the sum over its texts. ``lang_pred``: the
    language of the highest cosine of those two, the first in order at ties; ``und`` if the text is null or has no letter,
    or nothing was learned. ``score``: that cosine, cut to 0..1, 0 for ``und``.

    Whole texts of any length; null keys count as not held out; repeated rows and an empty table are no special cases.
    """
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    names_out = ["held_out", "lang_pred", "score"]
    given = [c for c in docs.columns if c not in names_out] if carry else [key]
    schema = docs.select(*given).schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors()
        for batch in slices(batches):
            codes, known = [], []
            for k, t in enumerate(batch.column(len(given) + 1).to_pylist()):
                own, many = trigrams(t) if t else (None, 0)
                if many and names:
                    codes.append(own)
                    known.append(k)
            found, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            vectors = bundle(codes, letters)
            cosines = (vectors @ unit.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            for k, row in zip(known, cosines, strict=True):
                best = int(row.argmax())
                found[k], score[k] = names[best], min(1.0, max(0.0, float(row[best])))
            kept = [batch.column(k) for k in range(len(given) + 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=given + names_out)

    return docs.select(*given, held_out(key).alias("__held_out"), F.col(text).alias("__text")).mapInArrow(run, schema)


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """Learn from the labelled rows that aren't held out, all of them, and predict every row."""
    names, prototypes = train(docs.where(~held_out(key)), text, lang)
    return identify(docs, names, prototypes, text, key, carry)

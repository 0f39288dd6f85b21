"""Token counts by the whole-token shortcut for a sentencepiece BPE model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import slices

SPACE = "▁"
RUNS = re.compile(r" +[^ ]*|[^ ]+")


class Words:
    """Token counts of words: the single tokens, and up to ``most`` of those that were merged."""

    def __init__(self, ones: dict[str, int], merge: Callable[[list[str]], list[int]], most: int):
        self.ones, self.merge, self.most = ones, merge, most
        self.known = dict(ones)

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > max(self.most, len(words) + len(self.ones)):
            self.known = dict(self.ones)
        rest = [w for w in words if w not in self.known]
        self.known.update(zip(rest, self.merge(rest), strict=True))


class PieceCounter:
    """Counts the tokens of texts without encoding most of their words.

    Proof, from the model file: the normalizer is the identity, so the model merges neighbouring pieces of the text as
    it stands, with a space before it and spaces as ``▁``. A merge makes a piece of the vocabulary; two neighbouring
    characters that no piece holds side by side are never merged, and what stands on either side of them is encoded
    alone. No piece holds a space after another character, none a line feed and another character: so texts fall apart
    before runs of spaces and around line feeds. Where the file breaks one of these conditions whole texts are encoded.
    Vocabulary strings that the library encodes alone as one token are counted as one by a lookup; other words are
    encoded by the library, once as long as they are among the ``most`` words kept.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        pieces = [p.piece for p in spec.pieces if p.type in (1, 4)]
        self.beside = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        special = any(p.type in (4,) for p in spec.pieces)
        self.splits = (
            not special
            and spec.trainer_spec.model_type == 2
            and not normal.precompiled_charsmap
            and normal.add_dummy_prefix
            and not normal.remove_extra_whitespaces
            and normal.escape_whitespaces
            and not any(b == SPACE != a or "\n" in (a, b) for a, b in self.beside)
        )
        self.newline = len(self.model.encode("\n")) - 1 if self.splits else 0
        if self.splits:
            after = [p[1:] for p in pieces if p[0] == SPACE and SPACE not in p[1:]]
            ones = {"": len(self.model.encode("\n")) - self.newline}  # a space that no word follows
            ones |= {w: 1 for w, ids in zip(after, self.model.encode(after, num_threads=1), strict=True) if len(ids) == 1}
            alone = [p for p in pieces if SPACE not in p]
            heads = {"": 0} | {w: 1 for w, n in zip(alone, self._after_newline(alone), strict=True) if n == 1}
            self.first = Words(ones, lambda words: [len(x) for x in self.model.encode(words, num_threads=1)], most)
            self.inner = Words(heads, self._after_newline, most)

    def _after_newline(self, words: list[str]) -> list[int]:
        return [len(ids) - self.newline - 1 for ids in self.model.encode(["\n" + w for w in words], num_threads=1)]

    def _parts(self, text: str) -> tuple[list[str], list[str], int]:
        """Words after a space (further spaces stand before them), words at the start of a later line, line feeds."""
        words, heads = [], []
        lines = text.split("\n")
        for k, line in enumerate(lines):
            parts = line.split(" ")
            if "" in parts:  # a run of spaces goes with the word after it
                parts = RUNS.findall(line if k else " " + line)
                if k:
                    heads.append(parts.pop(0) if parts and parts[0][0] != " " else "")
                words += [p[1:] for p in parts]
            elif k:
                heads.append(parts[0])
                words += parts[1:]
            else:
                words += parts
        return words, heads, len(lines) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode([t or "" for t in texts], num_threads=1)]
        first, inner = self.first.known.get, self.inner.known.get
        out, missing = [], []
        for k, t in enumerate(texts):
            words, heads, feeds = self._parts(t.replace(SPACE, " ")) if t else ((), (), 0)
            counts, rest = list(map(first, words)), list(map(inner, heads))
            if None in counts or None in rest:
                missing.append((k, [w for w, n in zip(words, counts, strict=True) if n is None], [w for w, n in zip(heads, rest, strict=True) if n is None]))
                counts, rest = filter(None, counts), filter(None, rest)
            out.append(sum(counts) + sum(rest) + feeds * self.newline)
        self.first.learn({w for _, words, _ in missing for w in words})
        self.inner.learn({w for _, _, heads in missing for w in heads})
        first, inner = self.first.known.__getitem__, self.inner.known.__getitem__
        for k, words, heads in missing:
            out[k] += sum(map(first, words)) + sum(map(inner, heads))
        return out


_counters: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_bytes (UTF-8), n_tokens as the library encodes the whole text, over_limit (n_tokens > limit).

    ``model``: file of a sentencepiece BPE model, on every executor. Null and empty texts: no bytes, no tokens. Rows and
    nulls in the key are kept as they are, repeated rows too; other columns aren't read. No shuffle; a worker holds one
    batch of at most 1 MB of text (a single longer text is held whole) and its word table.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = PieceCounter(model)
        counter = _counters[model]
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            tokens = counter.count(texts)
            sizes = [0 if t is None else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")

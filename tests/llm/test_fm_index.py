"""The FM-index against plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quire.llm.fm_index import FMIndex


@pytest.mark.parametrize("seed", range(60))
def test_matches_are_those_of_plain_search(seed):
    rng = random.Random(seed)
    width, letters = rng.choice([3, 5, 8, 50]), rng.choice([1, 2, 3, 30])
    docs = [[rng.randint(1, letters) for _ in range(rng.randint(width, 3 * width))] for _ in range(rng.randint(1, 6))]
    keys = np.array([rng.randint(0, 9) for _ in docs])
    index = FMIndex(np.array([x for d in docs for x in [*d, 0]]), keys, width)
    text, spans = [], []
    for _ in range(5):
        n, s = rng.randint(width, 2 * width - 1), []
        while len(s) < n:
            d = rng.choice(docs)
            a = rng.randrange(len(d))
            s += d[a : a + rng.randint(1, width + 3)] + [letters + 1] * (rng.random() < 0.3)
        spans.append((len(text), len(text) + n))
        text += [*s[:n], 0]
    block = index.matches(np.array(text), *(np.array(x) for x in zip(*spans, strict=True)))
    want = np.full(len(text), -1)
    for a, b in spans:
        for p in range(a, b - width + 1):
            found = [k for d, k in zip(docs, keys.tolist(), strict=True) if any(d[i : i + width] == text[p : p + width] for i in range(len(d) - width + 1))]
            want[p] = min(found, default=-1)
    assert np.where(block >= 0, index.least[block], -1).tolist() == want.tolist()

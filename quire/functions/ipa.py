"""Pronunciations: normal forms and look-up words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: American signs and what learners' dictionaries write, in order. A stress mark stands before a syllable, so
#: the first vowel after it is the stressed one.
US_SIGNS = [
    (r"([ˈˌ][^aæɑɔəɛɝeiɪouʊ/]*?)ə", r"\1ʌ"),
    (r"([ˈˌ][^aæɑɔəɛɝeiɪouʊʌ/]*?)ɝ", r"\1ɜːr"),
    ("ɝ", "ər"),
    ("ɹ", "r"),
    ("ɫ", "l"),
]
#: British signs, vowels, and the consonants that a syllable may begin with.
UK_SIGNS = {"ɐ": "ʌ", "ɛ": "e", "ɹ": "r", "g": "ɡ"}
UK_VOWELS = set("aɪ aʊ eɪ i iː uː æ ɑː ɒ ɔɪ ɔː ə əʊ e eə ɜː ɪ ɪə ʊ ʊə ʌ".split())
UK_ONSETS = set(
    "b d dʒ f ɡ h j k l m n p r s t tʃ v w z ð ʃ ʒ θ bl br dr fl fr ɡl ɡr kl kr pl pr sk sl sm sn sp st sw tr tw θr ʃr "
    "bj dj fj hj kj lj mj nj pj sj tj vj zj ɡj θj skr skw spl spr str".split()
)
_TO_UK = str.maketrans(UK_SIGNS)
_MARKS = "ˈˌ"


def us(text: str) -> str:
    for pattern, sign in US_SIGNS:
        text = re.sub(pattern, sign, text)
    return text


def us_column(text: Column) -> Column:
    for pattern, sign in US_SIGNS:
        text = F.regexp_replace(text, pattern, sign.replace("\\", "$"))
    return text


def uk(tokens: list[str]) -> str:
    """Signs joined between slashes; a stress mark moves from its vowel to the start of the syllable: the longest legal
    onset after the vowel before it, or the word's start."""
    signs = [t.translate(_TO_UK) for t in tokens]
    plain = [s[1:] if s[:1] in _MARKS else s for s in signs]
    before, vowel = [""] * (len(signs) + 1), -1
    for k, sign in enumerate(signs):
        if sign[:1] and sign[0] in _MARKS:
            starts = range(vowel + 1, k) if vowel >= 0 else [0]
            at = next((j for j in starts if vowel < 0 or "".join(plain[j:k]) in UK_ONSETS), k)
            before[at] = sign[0] + before[at]
        if plain[k] in UK_VOWELS:
            vowel = k
    return "/" + "".join(m + p for m, p in zip(before, plain, strict=False)) + "/"


def uk_column(tokens: Column) -> Column:
    """``uk`` of signs between white space."""
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: uk(x.split()), na_action="ignore")

    return run(tokens)


def lookup_word(value: str) -> str | None:
    """NFKC, plain apostrophes, lower case; null for what isn't one English word."""
    word = unicodedata.normalize("NFKC", value.strip()).replace("’", "'")
    return word.lower() if re.fullmatch(r"[A-Za-z]+(?:['-][A-Za-z]+)*", word) else None

"""Word segmentation of ideographic text by the best path through a dictionary's words.

A run of ideographs is a lattice: every dictionary word that stands in it is an arc, and so is every single
character. The tokens are the arcs of the path whose product of relative frequencies is greatest; a word that the dictionary does
not know, a single character that is, counts once. Of equally likely paths the one whose first word is longer wins, then whose second is, and so on.
Letters and digits in between are tokens as they are. Texts without ideographs never leave the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import IDEOGRAPHIC, WORD

# Frequency of words that the dictionary lists without one.
DEFAULT_FREQUENCY = 1
# A dictionary is copied to every task: the words it may have at most.
DICTIONARY_WORDS = 1_000_000
# Decimals to which path scores are compared, so that sums in any order agree on ties.
DECIMALS = 9

# A run of ideographs, or of other letters and digits; as in ``text.token_pattern``.
_RUNS = regex.compile(r"(?V1)(\p{Han}+)|[[\p{L}\p{N}]--\p{Han}]+")


def frequencies(dictionary: DataFrame) -> dict[str, int]:
    """Word frequencies of a dictionary (word, freq) as ``read_dictionary`` loads it; of a repeated word the greatest."""
    freq = F.greatest(F.coalesce("freq", F.lit(DEFAULT_FREQUENCY)), F.lit(1)).cast("bigint")
    words = dictionary.filter(F.coalesce("word", F.lit("")) != "").groupBy(F.lower("word").alias("word")).agg(F.max(freq).alias("freq"))
    rows = words.limit(DICTIONARY_WORDS + 1).collect()
    if len(rows) > DICTIONARY_WORDS:
        raise ValueError(f"a dictionary has {DICTIONARY_WORDS} words at most")
    return {r["word"]: r["freq"] for r in rows}


class Segmenter:
    """Cuts runs of ideographs along the best path."""

    def __init__(self, words: Mapping[str, int]) -> None:
        total = math.log(sum(words.values()) or 1)
        self.cost = {w: math.log(n) - total for w, n in words.items()}
        self.unknown = -total
        self.starts = {w[:n] for w in words for n in range(1, len(w))}

    def cut(self, run: str) -> list[str]:
        """Words of one run: the best score from each place on, found from the end."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for at in range(n - 1, -1, -1):
            found = (round(self.cost.get(run[at], self.unknown) + best[at + 1][0], DECIMALS), at + 1)
            end = at + 1
            while end < n and run[at:end] in self.starts:
                end += 1
                cost = self.cost.get(run[at:end])
                if cost is not None:
                    found = max(found, (round(cost + best[end][0], DECIMALS), end))
            best[at] = found
        out, at = [], 0
        while at < n:
            out.append(run[at : best[at][1]])
            at = best[at][1]
        return out

    def tokens(self, text: str) -> list[str]:
        out = []
        for run in _RUNS.finditer(text):
            out += self.cut(run[1]) if run[1] else [run[0]]
        return out


def best_path_tokens(text: Column, words: Iterable[str] | Mapping[str, int]) -> Column:
    """Lower-cased tokens in text order, ideographs cut along the best path; the same call serves pages and queries."""
    known = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, DEFAULT_FREQUENCY)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    segmenter = Segmenter({w.lower(): n for w, n in known.items()})

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else segmenter.tokens(t))

    plain = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    ideographic = lowered.rlike(IDEOGRAPHIC)
    return F.when(ideographic, cut(F.when(ideographic, lowered))).otherwise(plain)

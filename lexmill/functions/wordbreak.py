"""Dictionary segmentation of unspaced text: the most probable split, found by dynamic programming from the right."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import STOP_WORDS


class WordBreaker:
    """score = sum of ln(freq / total); on a tie the longer first word wins.  Stop words leave the result last.

    An unbreakable text raises ``ValueError`` or, with ``errors="null"``, gives None.  The total counts every
    dictionary line; a word given twice keeps its last frequency.
    """

    def __init__(self, entries: Iterable[tuple[str, float]], stop_words=STOP_WORDS, errors: str = "raise"):
        entries = list(entries)
        total = sum(f for _, f in entries)
        self.logp = {w: math.log(f / total) for w, f in entries if f > 0}
        self.longest = max((len(w) for w in self.logp), default=0)
        self.stop, self.errors = frozenset(stop_words), errors

    def split(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        text = text.lower()
        n = len(text)
        best: list[tuple[float, int] | None] = [None] * n + [(0.0, n)]
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if best[j] is not None and (p := self.logp.get(text[i:j])) is not None:
                    if best[i] is None or p + best[j][0] >= best[i][0]:
                        best[i] = (p + best[j][0], j)
        if best[0] is None:
            if self.errors == "null":
                return None
            raise ValueError(f"cannot be segmented: {text[:80]!r}")
        out, i = [], 0
        while i < n:
            j = best[i][1]
            out.append(text[i:j])
            i = j
        return [w for w in out if w not in self.stop]

    def tokens(self, spark: SparkSession, text: Column) -> Column:
        """An Arrow UDF; the dictionary (a resource of fixed size) goes to each executor once, as a broadcast."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(shared.value.split)

        return run(text)

"""Analysers as Column expressions: tokenising, lower-casing and stop words stay in the JVM.

``tokens`` methods return ``array<string>``; a null text gives an empty array.  ``analyze`` is the same function
on a Python string, used for query literals only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop-word list that results depend on.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now"
).split()
# Characters at which the punctuation tokenizer cuts, besides blank, tab, newline and return.
PUNCTUATION = (",", ".", ";", "?", "!")

JAVA_SPACE = r"[ \t\n\x0B\f\r]+"


class Tokenizer(Protocol):
    """Cuts a text into pieces."""

    def tokens(self, text: Column) -> Column: ...


class Stemmer(Protocol):
    """Brings a word to its stem."""

    def __call__(self, word: str) -> str: ...


class Analyzer(Protocol):
    def tokens(self, text: Column) -> Column: ...

    def analyze(self, text: str) -> list[str]: ...


@dataclass(frozen=True)
class PunctuationAnalyzer:
    """Cut at white space and punctuation, lower-case, drop empty pieces and stop words; order and repeats stay."""

    stop_words: tuple[str, ...] = tuple(STOP_WORDS)
    punctuation: tuple[str, ...] = PUNCTUATION

    @property
    def pattern(self) -> str:
        return r"[ \t\n\r" + "".join("\\" + c for c in self.punctuation) + "]+"

    def tokens(self, text: Column) -> Column:
        pieces = F.transform(F.split(F.coalesce(text, F.lit("")), self.pattern), F.lower)
        return F.filter(pieces, lambda x: (x != "") & ~x.isin(*self.stop_words))

    def analyze(self, text: str) -> list[str]:
        stop = set(self.stop_words)
        return [x for x in (p.lower() for p in re.split(self.pattern, text)) if x and x not in stop]


@dataclass(frozen=True)
class WhitespaceAnalyzer:
    """Lower-case and split at ASCII white space as Java does: a leading empty token stays, trailing ones go."""

    def tokens(self, text: Column) -> Column:
        cut = F.regexp_replace(F.lower(text), JAVA_SPACE + "$", "")
        empty = F.array().cast("array<string>")
        return (
            F.when(text.isNull(), empty)
            .when(text == "", F.array(F.lit("")))
            .when(cut == "", empty)
            .otherwise(F.split(cut, JAVA_SPACE))
        )

    def analyze(self, text: str) -> list[str]:
        if text == "":
            return [""]
        parts = re.split(JAVA_SPACE, text.lower())
        while parts and parts[-1] == "":
            parts.pop()
        return parts


@dataclass(frozen=True)
class StemmedAnalyzer:
    """A tokenizer followed by a stemmer.

    ``tokens`` applies the stemmer as one Arrow UDF over arrays; :func:`lexmill.operators.index.stem_tokens` is the
    cheaper form for whole corpora, as it stems the distinct vocabulary only.
    """

    base: PunctuationAnalyzer | WhitespaceAnalyzer = field(default_factory=PunctuationAnalyzer)

    def tokens(self, text: Column) -> Column:
        from lexmill.functions.stemmer import stem_array

        return stem_array(self.base.tokens(text))

    def analyze(self, text: str) -> list[str]:
        from lexmill.functions.stemmer import stem

        return [stem(x) for x in self.base.analyze(text)]

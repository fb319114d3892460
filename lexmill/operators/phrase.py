"""Phrase search: tokens of the phrase at consecutive positions, in order, by one offset join and one count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.index import TextIndex


def phrase_starts(toks: DataFrame, terms: list[str], *key: str) -> DataFrame:
    """(key, start) of every occurrence.  (key, pos) is unique, so a start with as many hits as terms is a match;
    the query has as many rows as the phrase has words, which bounds the broadcast."""
    keys = key or ("doc_id",)
    query = toks.sparkSession.createDataFrame(list(enumerate(terms)), "_off int, term string")
    hits = toks.join(F.broadcast(query), "term").groupBy(*keys, (F.col("pos") - F.col("_off")).alias("start")).agg(F.count("*").alias("_n"))
    return hits.filter(F.col("_n") == len(terms)).select(*keys, "start")


def search_phrase(index: TextIndex, phrase: list[str]) -> DataFrame:
    if not index.positional:
        raise NotImplementedError("the index has no positions")
    terms = index.analyzer.analyze(" ".join(phrase)) if phrase else []
    if not terms:
        return index.documents.limit(0)
    toks = index.postings.filter(F.col("term").isin(terms)).select("doc_id", "term", F.explode(index.positions()).alias("pos"))
    return index.documents.join(phrase_starts(toks, terms).select("doc_id"), "doc_id", "left_semi")

"""Keyword, AND, OR and full-scan search: filters on postings and a relational division, never n-way joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import Analyzer, PunctuationAnalyzer
from lexmill.operators.index import TextIndex, tokens


def query_terms(analyzer: Analyzer, keywords: list[str]) -> list[str]:
    """Distinct tokens of all keywords; stop words vanish and so do not constrain."""
    return list(dict.fromkeys(t for k in keywords for t in analyzer.analyze(k)))


def docs_with_all(toks: DataFrame, terms: list[str], *key: str) -> DataFrame:
    """Keys that hold every term: one shuffle of matching rows only.  No term: no row."""
    keys = key or ("doc_id",)
    hits = toks.filter(F.col("term").isin(terms)).groupBy(*keys).agg(F.count_distinct("term").alias("_n"))
    return hits.filter(F.col("_n") == max(1, len(terms))).select(*keys)


def docs_with_any(toks: DataFrame, terms: list[str], *key: str) -> DataFrame:
    return toks.filter(F.col("term").isin(terms)).select(*(key or ("doc_id",))).distinct()


def search_keyword(index: TextIndex, keyword: str) -> DataFrame:
    if keyword is None:
        raise TypeError("a keyword is needed")
    return search_and(index, [keyword])


def search_and(index: TextIndex, keywords: list[str]) -> DataFrame:
    """Documents with every token; an empty list or an empty keyword gives none."""
    terms = [] if any(k == "" for k in keywords) else query_terms(index.analyzer, keywords)
    if not terms:
        return index.documents.limit(0)
    hits = index.postings.filter(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(terms))
    return index.documents.join(hits.select("doc_id"), "doc_id", "left_semi")


def search_or(index: TextIndex, keywords: list[str]) -> DataFrame:
    terms = query_terms(index.analyzer, [k for k in keywords if k != ""])
    if not terms:
        return index.documents.limit(0)
    return index.documents.join(docs_with_any(index.postings, terms), "doc_id", "left_semi")


def full_scan(docs: DataFrame, keyword: str, analyzer: Analyzer | None = None) -> DataFrame:
    """No index: documents whose tokens include all of the keyword's; narrow, no shuffle."""
    analyzer = analyzer or PunctuationAnalyzer()
    terms = query_terms(analyzer, [keyword])
    if not terms:
        return docs.limit(0)
    have = analyzer.tokens(F.col("text"))
    return docs.filter(F.size(F.array_except(F.array(*map(F.lit, terms)), have)) == 0)


def search_conversations(conversations: DataFrame, keywords: list[str], analyzer: Analyzer | None = None) -> DataFrame:
    analyzer = analyzer or PunctuationAnalyzer()
    keys = ["conv_id", "turn"]
    return docs_with_all(tokens(conversations, analyzer, keys), query_terms(analyzer, keywords), *keys)

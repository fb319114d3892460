"""TF-IDF: idf = log10(N / df) with no smoothing; score = dot product / norm over the query's terms only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.index import TextIndex


def idf(tf: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """tf: one row per (term, document)."""
    return tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log10(F.lit(float(n_docs)) / F.col("df")))


def scores(tf: DataFrame, n_docs: int, terms: list[str], key: str = "doc_id") -> DataFrame:
    """tf: (term, key, tf).  Filtering to the query's terms comes first; only matching rows are shuffled.

    The query and its idf have a row for each distinct query term, which bounds the broadcasts.
    """
    counts = Counter(terms)
    query = tf.sparkSession.createDataFrame(list(counts.items()) or [("", 0)], "term string, qtf int")
    hits = tf.filter(F.col("term").isin(list(counts)))
    weights = idf(hits, n_docs).join(F.broadcast(query), "term").select("term", "idf", (F.col("qtf") * F.col("idf")).alias("qw"))
    w = F.col("tf") * F.col("idf")
    acc = hits.join(F.broadcast(weights), "term").groupBy(key).agg(F.sum(w * F.col("qw")).alias("_dot"), F.sum(w * w).alias("_len"))
    return acc.select(key, F.when(F.col("_len") > 0, F.col("_dot") / F.sqrt("_len")).otherwise(F.lit(0.0)).alias("score"))


def top(scored: DataFrame, k: int | None, key: str = "doc_id") -> DataFrame:
    """Best k by score, then key: a bounded heap per partition.  None: all; 0: none."""
    ordered = scored.orderBy(F.desc("score"), F.asc(key))
    return ordered if k is None else ordered.limit(k)


def search_tfidf(index: TextIndex, keywords: list[str], k: int | None = None) -> DataFrame:
    """(doc_id, score, text), best first; the text is joined after the cut."""
    terms = index.analyzer.analyze(" ".join(keywords))
    best = top(scores(index.postings, index.documents.count(), terms), k)
    return best.join(index.documents.select("doc_id", "text"), "doc_id").orderBy(F.desc("score"), F.asc("doc_id"))

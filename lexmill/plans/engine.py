"""The web search engine: ingest a crawl folder, rank its link graph, answer queries by relevance plus rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import Analyzer, StemmedAnalyzer
from lexmill.operators.graph import combine, pagerank, ranked
from lexmill.operators.index import TextIndex
from lexmill.operators.ranking import scores
from lexmill.sources import corpus
from lexmill.sources.docstore import numbered


class SearchEngine:
    def __init__(self, spark: SparkSession, folder: str, analyzer: Analyzer | None = None):
        self.spark, self.folder, self.analyzer = spark, folder, analyzer or StemmedAnalyzer()
        self.index: TextIndex | None = None
        self.ranks: DataFrame | None = None

    def write_index(self, flush_threshold: int = 1000, merge_threshold: int = 8) -> TextIndex:
        """Files in the order of their numbers; the whole file (id and URL lines too) is the document's text."""
        pages = corpus.pages(self.spark, self.folder)
        docs = numbered(pages, "ordinal_key", "doc_id").select("doc_id", "page_id", F.col("document").alias("text"))
        self.index = TextIndex.build(docs, self.analyzer, flush_threshold=flush_threshold, merge_threshold=merge_threshold)
        return self.index

    def compute_pagerank(self, iterations: int) -> DataFrame:
        self.ranks = pagerank(corpus.edges(self.spark, f"{self.folder}/id-graph.tsv"), iterations)
        return self.ranks

    def pagerank_scores(self) -> DataFrame:
        if self.ranks is None:
            raise ValueError("compute_pagerank comes first")
        return ranked(self.ranks)

    def search(self, keywords: list[str], k: int | None, weight: float) -> DataFrame:
        """(page_id, score), best first."""
        terms = self.analyzer.analyze(" ".join(keywords))
        scored = scores(self.index.postings, self.index.documents.count(), terms)
        by_page = scored.join(self.index.documents.select("doc_id", "page_id"), "doc_id").select("page_id", "score")
        return combine(by_page, self.ranks, weight, k, "page_id")

"""A training-corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of documents, whatever these are named; nulls, empty and very long texts, ties,
repeated rows and empty tables are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, minhash_dedup, packing, substring_dedup, toxicity
from lexmill.llm.common import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that of the smallest id stays."""
    return minhash_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that recur go; a text that loses none is unchanged."""
    carried = [c for c in docs.columns if c != "text"]
    at = {c: f"_c{i}" for i, c in enumerate(carried)}
    # Columns by position, so that no name of a column can clash with those of the result.
    found = substring_dedup.substring_dedup(docs, with_text=True).toDF(*at.values(), "_words", "_removed", "_text")
    columns = {c: F.col(a) for c, a in at.items()} | {"text": F.col("_text")}
    if "n_chars" in at:
        length = F.length("_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("_removed") > 0, length).otherwise(F.col(at["n_chars"]))
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned scores and components are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Web-page folders, link lists and frequency dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file of ``<folder>/cleaned``: line 0 the page id, line 1 its URL, the rest its text.

    ``ordinal_key`` is the number after the file name's last underscore (0 if there is none), the ingest order.
    """
    raw = spark.read.text(f"{folder}/cleaned", wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = F.split("value", "\r?\n", 3)
    number = F.regexp_extract("file", r"_(\d+)(?:\.[^.]*)?$", 1)
    return raw.select(
        F.when(number == "", F.lit(0)).otherwise(number.cast("int")).alias("ordinal_key"),
        F.trim(lines[0]).cast("long").alias("page_id"),
        lines[1].alias("url"),
        F.coalesce(F.get(lines, 2), F.lit("")).alias("text"),
        F.col("value").alias("document"),
    )


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``src dst`` parted by one white-space character."""
    part = F.split("value", r"\s")
    return spark.read.text(path).filter(F.trim("value") != "").select(part[0].cast("int").alias("src"), part[1].cast("int").alias("dst"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``word freq``, cut at the first blank; a byte-order mark is dropped."""
    line = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(path).select(F.regexp_extract(line, r"^([^ ]*) ", 1).alias("word"), F.regexp_extract(line, r"^[^ ]* (.*)$", 1).cast("double").alias("freq"))

"""A document store kept as Parquet: upserts are appended with a sequence number and the last write wins on read."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.plans.lineage import cut, parts

SCHEMA = "doc_id long, text string, seq long"


def latest(df: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The last row of each key, by one shuffle with a partial aggregate (no window, so no sort of a key's rows)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(key, "last.*")


class DocumentStore(Protocol):
    """What search needs of a store of documents."""

    def documents(self) -> DataFrame: ...

    def scan(self) -> DataFrame: ...

    def keys(self) -> DataFrame: ...

    def get(self, doc_id: int) -> DataFrame: ...

    def put(self, docs: DataFrame) -> None: ...

    def size(self) -> int: ...


class DocStore:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path, read_only

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> DocStore:
        """Create the store if it is missing; a missing store opened read-only is an error."""
        store = cls(spark, path, read_only)
        if not store._exists():
            if read_only:
                raise FileNotFoundError(path)
            spark.createDataFrame([], SCHEMA).write.parquet(path)
        return store

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @classmethod
    def bulk_load(cls, docs: DataFrame, path: str) -> DocStore:
        """docs: doc_id, text with unique ids; files are sorted by id so that row-group statistics prune point reads."""
        rows = docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("seq"))
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)
        return cls(docs.sparkSession, path)

    def put(self, docs: DataFrame) -> None:
        """Upsert; a null text is refused as the store holds documents only."""
        if self.read_only:
            raise PermissionError(self.path)
        text = F.when(F.col("text").isNull(), F.raise_error(F.lit("null document"))).otherwise(F.col("text"))
        seq = self.spark.read.schema(SCHEMA).parquet(self.path).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(self.path)

    def documents(self) -> DataFrame:
        return latest(self.spark.read.schema(SCHEMA).parquet(self.path)).select("doc_id", "text")

    def scan(self) -> DataFrame:
        """All documents in key order."""
        return self.documents().orderBy("doc_id")

    def keys(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).select("doc_id").distinct()

    def get(self, doc_id: int) -> DataFrame:
        """Zero or one row; the filter reaches the Parquet scan."""
        return latest(self.spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("doc_id") == doc_id)).select("doc_id", "text")

    def size(self) -> int:
        return self.keys().count()


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add the 0-based ordinal of each row by unique key.

    Keys alone are sorted in ranges of equal size, whatever their values, and written to the checkpoint folder; the ranges'
    sizes, a row for each, are summed in one place and broadcast.  The rows meet their ordinals by a hash join that holds
    ordinals only and sorts nothing, in partitions whose number grows with the input.
    """
    row = F.monotonically_increasing_id()  # range number << 33 | place in the range
    keys = cut(df.select(F.col(key).alias("_key")).orderBy("_key").withColumn("_at", row))
    sizes = keys.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    placed = keys.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range"))
    placed = placed.select("_key", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))
    return df.repartition(parts(df), key).join(placed.hint("shuffle_hash"), F.col(key) == F.col("_key")).drop("_key")

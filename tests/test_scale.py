"""Work that must stay inside rows, and partitions whose number follows the input."""

from pyspark.sql import functions as F

from lexmill.functions import codec
from lexmill.functions.text import PunctuationAnalyzer
from lexmill.operators import index
from lexmill.operators.index import TextIndex
from lexmill.plans import lineage
from lexmill.sources.docstore import numbered

# Texts with repeats, with nothing, with one word, and null.
TEXTS = ["cat dog cat bird cat", "", None, "cat", "dog dog. DOG, the dog!", "the", "ü cat é ü"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def lists(df):
    return sorted((r.doc_id, r.term, list(r.positions)) for r in df.collect())


def test_positions_are_grouped_inside_rows(spark):
    docs = frame(spark)
    found = index.row_terms(docs, PunctuationAnalyzer())
    assert "Exchange" not in plan(found)[1] and "Aggregate" not in plan(found)[1]
    assert lists(found) == lists(index.positional_lists(index.tokens(docs)))


def test_index_is_built_without_shuffling_tokens(spark, tmp_path):
    built = TextIndex.build(frame(spark), flush_threshold=2, merge_threshold=2, codec=codec.DeltaCompressor())
    text = plan(built.postings)[1]
    assert "ObjectHashAggregate" not in text and "SortMergeJoin" not in text
    built.save(str(tmp_path / "ix"))
    loaded = TextIndex.load(spark, str(tmp_path / "ix"), codec=codec.DeltaCompressor())
    assert lists(loaded.postings.select("doc_id", "term", loaded.positions().alias("positions"))) == lists(index.positional_lists(index.tokens(frame(spark))))


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text")).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(lineage, "PART_BYTES", 1000)
    many = lineage.parts(docs)
    assert many > 32 and lineage.parts(docs.unionAll(docs)) >= 2 * many - 1
    assert numbered(docs, "doc_id", "o").rdd.getNumPartitions() == many
    assert lineage.parts(frame(spark)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_merging_leaves_postings_where_they_are(spark, monkeypatch):
    built = TextIndex.build(frame(spark), flush_threshold=2, merge_threshold=4)
    merged = built.merge_pairs()
    assert plan(merged.postings)[1].count("Exchange hashpartitioning") == plan(built.postings)[1].count("Exchange hashpartitioning")
    assert "segment_id" not in "".join(x for x in plan(merged.postings)[1].splitlines() if "Exchange hashpartitioning" in x)
    rows = lambda ix: sorted(tuple(r) for r in ix.postings.select("segment_id", "term", "local_doc_id", "doc_id", "tf").collect())
    wide = rows(merged)
    monkeypatch.setattr(index, "BROADCAST_SEGMENTS", 0)
    assert rows(built.merge_pairs()) == wide


def test_running_sums_in_levels(spark):
    n = 5000
    sums = [r.s for r in spark.range(1).select(F.explode(codec._running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("long")))).alias("s")).collect()]
    assert sums == [i * (i + 1) // 2 for i in range(1, n + 1)]
    assert 4_000_000 / codec.RUN**codec.LEVELS < 256


def test_decoding_any_group(spark):
    values = [0, 1, 127, 128, 129, 16383, 16384, 16385, 2097151, 2097152, 2**28, 2**31 - 1]
    data = spark.createDataFrame([(values,), ([],), ([7],), (None,)], "v array<int>").select("v", codec.delta_encode(F.col("v")).alias("b"))
    assert [r.d for r in data.select(codec.delta_decode(F.col("b")).alias("d")).collect()] == [values, [], [7], []]
    odd = spark.createDataFrame([(bytearray(b"\x0a\x0d\x00\x81"),)], "b binary")
    assert odd.select(codec.delta_decode(F.col("b"))).first()[0] == [10, 23, 23]


def test_round_trip_of_long_lists_is_linear(spark):
    import time

    took = []
    for n in (4, 500_000, 2_000_000):
        data = spark.range(1, numPartitions=1).select(codec.delta_encode(F.sequence(F.lit(1), F.lit(n))).alias("b")).localCheckpoint()
        began = time.time()
        assert data.select(F.size(F.filter(codec.delta_decode(F.col("b")), lambda x, i: x == i + 1))).first()[0] == n
        took.append(time.time() - began)
    assert took[2] < 8 * max(took[1], 0.5)


def test_lists_of_repeated_keys_meet(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (1, "cat"), (2, "cat cat")], "doc_id long, text string")
    assert lists(index.document_positions(docs)) == [(1, "cat", [0, 0]), (1, "dog", [1]), (2, "cat", [0, 1])]
    once = index.document_positions(docs.filter("text <> 'cat'"))
    assert "term" not in "".join(x for x in plan(once)[1].splitlines() if "Exchange" in x)

"""Registered queries on the smallest tables: SQL where there is some, the pipeline against its parts."""

import pytest

from lexmill.llm.entries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    compare(spark, connect(SF), QUERIES[name], ORACLE_SQL[name], SF)


def test_pipeline(spark):
    """run() packs exactly what brute-force versions of its middle stages leave, given the toxicity verdicts."""
    import corpus_pipeline
    from lexmill.llm import packing
    from tests.llm.test_operators import ALNUM, ascii_lower, brute_cut, brute_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = corpus_pipeline.drop_toxic(spark, docs, SF).orderBy("doc_id").collect()
    data = [r for r, g in zip(data, brute_groups(data), strict=True) if g[3]]
    cut = brute_cut([r.text for r in data])
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM.findall(ascii_lower(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1 if n else 0)}
    found = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(data, docs.schema), SF)
    texts = {r.doc_id: r.text for r in found.collect()}
    assert len(texts) == len(data)
    for r, c in zip(data, cut, strict=True):
        assert len(texts[r.doc_id].encode().split()) == c[0] - c[1]
    left = set()
    for i, t in texts.items():
        w = ALNUM.findall(ascii_lower(t))
        if not any(tuple(w[p : p + n]) in windows for n in {len(x) for x in windows} for p in range(len(w) - n + 1)):
            left.add(i)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == left
    want = packing.pack(spark.createDataFrame([(i, texts[i]) for i in left], "doc_id long, text string"))
    assert sum(r.length for r in out) == want.agg({"length": "sum"}).first()[0]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_finds_every_link_of_whole_table(spark):
    """Every document of an id divisible by 20 against all documents of sf0.01, by brute force."""
    from tests.llm.test_operators import brute_sets

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.component_id for r in QUERIES["op4_minhash_dedup"](spark, "/root/testdata/sf0.01").collect()}
    sets = brute_sets(docs.collect())
    asked, linked = [i for i in sets if i % 20 == 0 and sets[i]], 0
    for i in asked:
        for j, s in sets.items():
            if i != j and s and 100 * min(len(s), len(sets[i])) >= 85 * max(len(s), len(sets[i])) and 100 * len(s & sets[i]) >= 85 * len(s | sets[i]):
                linked += 1
                assert found[i] == found[j]
    assert linked > 0

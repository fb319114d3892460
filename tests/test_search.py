"""Literal cases for analysers, index, search, ranking, codecs, graph, document store and ingest."""

import math

import pytest
from pyspark.sql import functions as F

from lexmill.functions import codec
from lexmill.functions.stemmer import stem
from lexmill.functions.text import PunctuationAnalyzer, StemmedAnalyzer, WhitespaceAnalyzer
from lexmill.functions.wordbreak import WordBreaker
from lexmill.operators import boolean, graph, index, phrase, ranking
from lexmill.operators.index import TextIndex, simulate_flushes
from lexmill.sources import corpus
from lexmill.sources.docstore import DocStore, numbered

PS = StemmedAnalyzer()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


# Inputs and answers of the literal cases below must be as they are.
PUNCT = {
    "I am Happy Today!": ["happy", "today"],
    "uci cs221\tinformation\nretrieval": ["uci", "cs221", "information", "retrieval"],
    "uci~cs221/information>retrieval": ["uci~cs221/information>retrieval"],
    "I don't like your! You are a fast man!": ["don't", "like", "fast", "man"],
    "UCI : \na, public research university located in Irvine,California!!!!": ["uci", ":", "public", "research", "university", "located", "irvine", "california"],
    "": [], "   ": [], "!,": [],
}
NAIVE = {"UCI CS221 Information Retrieval": ["uci", "cs221", "information", "retrieval"], "  a  b ": ["", "a", "b"], "": [""], " \n": []}


@pytest.mark.parametrize("analyzer,cases", [(PunctuationAnalyzer(), PUNCT), (WhitespaceAnalyzer(), NAIVE)])
def test_analyzers(spark, analyzer, cases):
    rows = frame(spark, list(cases)).select("text", analyzer.tokens(F.col("text")).alias("t")).collect()
    assert {r.text: r.t for r in rows} == cases
    assert {t: analyzer.analyze(t) for t in cases} == cases


def test_null_text_has_no_tokens(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert index.tokens(df).count() == 0


STEMS = [
    ("stemming is an important concept in computer science", "stem is an import concept in comput scienc"),
    ("rate roll sky feed bled sing caress 1234", "rate roll sky feed bled sing caress 1234"),
    ("ties dogs caress need agreed disabled fitting making missing meeting meetings", "ti dog caress need agre disabl fit make miss meet meet"),
    ("conflated troubled sized hopping fizzed failing filing", "conflat troubl size hop fizz fail file"),
    ("relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti",
     "relat condit ration valenc hesit digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit sensibl"),
    ("triplicate formative formalize electriciti electrical hopeful goodness", "triplic form formal electr electr hope good"),
    ("revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize",
     "reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt homolog commun activ angular homolog effect bowdler"),
    ("probate rate cease controll roll", "probat rate ceas control roll"),
]


@pytest.mark.parametrize("words,stems", STEMS)
def test_stemmer(words, stems):
    assert " ".join(map(stem, words.split())) == stems


def test_word_break():
    b = WordBreaker([("x", 4), ("y", 4), ("xy", 1), ("zz", 7)])
    assert b.split("xy") == ["xy"]
    assert WordBreaker([("cat", 1), ("and", 1), ("dog", 1)]).split("catANDdog") == ["cat", "dog"]
    with pytest.raises(ValueError):
        b.split("b")
    assert WordBreaker([("a", 1)], errors="null").split("b") is None
    assert len(WordBreaker([("ab", 1)]).split("ab" * 20_000)) == 20_000


@pytest.mark.parametrize("values,hexed", [([1, 2, 3, 4, 5, 6], "010101010101"), ([128, 384, 896, 1920, 3968], "81008200840088009000"), ([2147483647], "87FFFFFF7F"), ([16384, 32770, 49153], "818000818002FF7F"), ([0, 0, 0, 0], "00000000"), ([131], "8103"), ([], "")])
def test_codec(spark, values, hexed):
    df = spark.createDataFrame([(values,)], "v array<int>").select("v", F.hex(codec.delta_encode("v")).alias("h"), codec.delta_decode(codec.delta_encode("v")).alias("d"), codec.naive_decode(codec.naive_encode("v")).alias("n"))
    r = df.first()
    assert (r.h, r.d, r.n) == (hexed, values, values)


def test_codec_slice(spark):
    df = spark.createDataFrame([(bytearray.fromhex("8180027F038103"),)], "b binary")
    assert df.select(codec.delta_decode(F.col("b"), 3, 4).alias("d")).first().d == [127, 130, 261]


def test_codec_of_long_lists(spark):
    values = [i * i // 7 for i in range(1000)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    assert df.select(codec.delta_decode(codec.delta_encode("v")).alias("d")).first().d == values


def test_compressed_index(spark):
    """An index with a codec answers as one without, from fewer bytes."""
    docs = frame(spark, ["a b x a y c", "a a " * 40, "a b a", "a c c", "a b c"])
    plain = TextIndex.build(docs, WhitespaceAnalyzer())
    small, wide = (TextIndex.build(docs, WhitespaceAnalyzer(), codec=c()) for c in (codec.DeltaCompressor, codec.NaiveCompressor))
    assert small.stored_bytes() * 4 == wide.stored_bytes() == plain.stored_bytes()
    lists = lambda ix: sorted((r.term, r.local_doc_id, tuple(r.positions)) for r in ix.segment_positional(0).collect())
    assert lists(small) == lists(wide) == lists(plain)
    assert ids(phrase.search_phrase(small, ["a b c"])) == ids(phrase.search_phrase(wide, ["a b c"])) == [4]


def test_merge_in_store(spark, tmp_path):
    path = str(tmp_path / "merged")
    docs = frame(spark, ["what is he doing", "a dog", "you saw a dog", "there it is"])
    TextIndex.build(docs, WhitespaceAnalyzer(), flush_threshold=1, merge_threshold=100).save(path)
    before = TextIndex.load(spark, path, WhitespaceAnalyzer())
    assert before.num_segments() == 4
    merged = TextIndex.merge_stored(spark, path, WhitespaceAnalyzer())
    assert merged.num_segments() == 2 and [p.name for p in (tmp_path / "merged").iterdir() if p.is_dir()] == ["version=1"]
    assert ids(boolean.search_keyword(merged, "dog")) == [1, 2]
    assert {r.term: r.docs for r in merged.segment(1).collect()}["dog"] == [0]
    with pytest.raises(FileNotFoundError):
        TextIndex.load(spark, str(tmp_path / "nothing"))


def test_numbered_of_uneven_keys(spark):
    keys = [-(10**15), *range(500), 10**17, 10**18]
    df = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string").repartition(4)
    assert [r.o for r in numbered(df, "doc_id", "o").orderBy("doc_id").collect()] == list(range(len(keys)))
    assert numbered(df.limit(0), "doc_id", "o").count() == 0


def test_dictionary_and_bulk_load(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("\ufeffcat 5\ndog 2\n", encoding="utf-8")
    assert [tuple(r) for r in corpus.dictionary(spark, str(tmp_path / "dict.txt")).collect()][0] == ("cat", 5.0)
    store = DocStore.bulk_load(frame(spark, ["a", "b", "c"]), str(tmp_path / "store"))
    assert store.size() == 3 and store.get(1).first().text == "b" and [r.doc_id for r in store.scan().collect()] == [0, 1, 2]


def test_flush_and_merge_counts():
    sizes = lambda plan: [sum(x[1] for x in plan if x[2] == s) for s in sorted({x[2] for x in plan})]
    assert sizes(simulate_flushes(100, 10, 10)) == [20] * 5
    assert sizes(simulate_flushes(6, 1, 4)) == [4, 2]
    assert sizes(simulate_flushes(2, 1, 2)) == [2]
    with pytest.raises(ValueError):
        simulate_flushes(3, 1, 3)


def test_merge_keeps_lists(spark):
    docs = frame(spark, ["what is he doing today", "what a cute dog", "i saw you doing there today", "a dog is there"])
    ix = TextIndex.build(docs, WhitespaceAnalyzer(), flush_threshold=2, merge_threshold=8)
    assert ix.num_segments() == 2
    merged = ix.merge_all()
    got = {r.term: r.docs for r in merged.segment(0).collect()}
    want = {"what": [0, 1], "is": [0, 3], "he": [0], "doing": [0, 2], "today": [0, 2], "a": [1, 3], "cute": [1], "dog": [1, 3], "i": [2], "saw": [2], "you": [2], "there": [2, 3]}
    assert got == want
    assert merged.segment(7) is None
    assert ids(boolean.search_and(ix, ["dog is"])) == ids(boolean.search_and(merged, ["dog is"])) == [3]


def test_positions(spark):
    ix = TextIndex.build(frame(spark, ["rate roll rate sing roll", "rate sky rate rate"]), PS)
    got = {(r.term, r.local_doc_id): r.positions for r in ix.segment_positional(0).collect()}
    assert got == {("rate", 0): [0, 2], ("rate", 1): [0, 2, 3], ("roll", 0): [1, 4], ("sing", 0): [3], ("sky", 1): [1]}


def test_boolean(spark):
    ix = TextIndex.build(frame(spark, ["cat dog cat dog", "apple dog", "cat smile"]), PS)
    assert ids(boolean.search_or(ix, ["cat", "apple"])) == [0, 1, 2]
    assert ids(boolean.search_or(ix, [""])) == ids(boolean.search_or(ix, [","])) == ids(boolean.search_and(ix, [""])) == ids(boolean.search_and(ix, [])) == []
    assert ids(boolean.search_keyword(ix, "cat")) == [0, 2]
    assert ids(boolean.search_keyword(ix, "the")) == []
    with pytest.raises(TypeError):
        boolean.search_keyword(ix, None)
    assert ids(boolean.full_scan(frame(spark, ["uci a", "b", "Uci"]), "uci")) == [0, 2]


def test_phrase(spark):
    ix = TextIndex.build(frame(spark, ["a b x a y c", "a a", "a b a", "a c c", "a b c"]), WhitespaceAnalyzer())
    assert ids(phrase.search_phrase(ix, ["a b c"])) == [4]
    assert ids(phrase.search_phrase(ix, ["a", "a"])) == [1]
    assert ids(phrase.search_phrase(ix, ["a b a"])) == [2]
    assert ids(phrase.search_phrase(ix, [])) == []
    young = TextIndex.build(frame(spark, ["too young, too simple, sometimes naive"]), PS)
    assert ids(phrase.search_phrase(young, ["too young too simple"])) == [0]
    assert ids(phrase.search_phrase(young, ["young naive"])) == []
    with pytest.raises(NotImplementedError):
        phrase.search_phrase(TextIndex.build(frame(spark, ["a"]), positional=False), ["a"])


def test_tfidf(spark):
    ix = TextIndex.build(frame(spark, ["test search project", "search engine is our project", "we need to finish the project"]), PS)
    best = ranking.search_tfidf(ix, ["search", "engine", "project"], 2).collect()
    assert [(r.doc_id, round(r.score, 3)) for r in best] == [(1, 0.509), (0, 0.176)]
    ix = TextIndex.build(frame(spark, ["cat dog", "cat elephant", "wolf dog dog", "cat dog dog"]), PS, flush_threshold=3)
    got = [(r.doc_id, round(r.score, 6)) for r in ranking.search_tfidf(ix, ["cat", "dog", "dog"], 3).collect()]
    u = math.log10(4 / 3)
    assert got == [(3, round(math.sqrt(5) * u, 6)), (0, round(3 / math.sqrt(2) * u, 6)), (2, round(2 * u, 6))]
    assert ranking.search_tfidf(ix, ["nosuch"], 3).count() == 0
    assert ranking.search_tfidf(ix, ["cat"], 0).count() == 0


def test_pagerank(spark):
    pr = lambda e, n: {r.id: round(r.pr, 6) for r in graph.pagerank(spark.createDataFrame(e, "src int, dst int"), n).collect()}
    assert pr([(1, 2), (2, 1)], 7) == {1: 1.0, 2: 1.0}
    assert pr([(1, 2)], 1) == {1: 0.15, 2: 1.0}
    assert pr([(1, 2)], 2) == {1: 0.15, 2: 0.2775}
    assert pr([(1, 2)], 0) == {1: 0.0, 2: 0.0}
    w = pr([(1, 2), (1, 2), (1, 3)], 1)
    assert (w[2], w[3]) == (round(0.15 + 0.85 * 2 / 3, 6), round(0.15 + 0.85 / 3, 6))


def test_docstore(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        DocStore.open(spark, path, read_only=True)
    s = DocStore.open(spark, path)
    s.put(frame(spark, ["a", "b"]))
    s.put(spark.createDataFrame([(1, "c"), (5, "d")], "doc_id long, text string"))
    assert [tuple(r) for r in s.scan().collect()] == [(0, "a"), (1, "c"), (5, "d")]
    assert (s.size(), s.get(1).first().text, s.get(9).count()) == (3, "c", 0)


def test_delete_and_compact(spark):
    docs = frame(spark, ["cat dog", "cat", "dog", "bird", "dog x", "fish", "dog y", "ant"])
    ix = TextIndex.build(docs, WhitespaceAnalyzer(), flush_threshold=1, merge_threshold=100)
    gone = ix.delete("dog")
    assert ix.documents.count() == 8 and gone.count() == 4
    out = ix.compact(gone)
    assert out.documents.count() == 4 and out.num_segments() == 2
    assert out.postings.filter("term = 'dog'").count() == 0


def test_save_load_append(spark, tmp_path):
    path = str(tmp_path / "ix")
    TextIndex.build(frame(spark, ["cat dog", "cat"])).save(path)
    ix = TextIndex.load(spark, path).append(spark.createDataFrame([(9, "dog")], "doc_id long, text string"))
    assert ids(boolean.search_and(ix, ["dog"])) == [0, 9] and ix.num_segments() == 2


def test_stream_ingest(spark, tmp_path):
    from lexmill.streaming.ingest import ingest

    frame(spark, ["cat dog", "cat"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    assert ids(boolean.search_and(TextIndex.load(spark, str(tmp_path / "ix")), ["dog"])) == [0]


def test_engine(spark, tmp_path):
    from lexmill.plans.engine import SearchEngine

    (tmp_path / "cleaned").mkdir()
    for i, body in enumerate(["apple pie", "apple apple", "plum"]):
        (tmp_path / "cleaned" / f"page_{i}.txt").write_text(f"{i}\nhttp://x/{i}\n{body}")
    (tmp_path / "id-graph.tsv").write_text("0\t2\n1\t0\n2\t0\n")
    e = SearchEngine(spark, str(tmp_path))
    e.write_index()
    e.compute_pagerank(5)
    assert [r.page_id for r in e.search(["apple"], 5, 1e6).collect()] == [0, 1]
    assert e.pagerank_scores().first().id == 0


@pytest.mark.parametrize("n", [300, 350, 200])
def test_registered_merge_of_odd_and_even_segments(spark, tmp_path, n):
    """300 documents make three segments, 350 four, the last one short."""
    import duckdb

    from lexmill.plans.registry import REGISTRY

    rows = [(i * 3, f"word{i % 7} common common w{i}") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("merged_segments", "merged_postings"):
        fn, sql = REGISTRY[name]
        df = fn(spark, str(tmp_path))
        want = con.execute(sql)
        assert df.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())

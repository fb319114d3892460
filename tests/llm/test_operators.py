"""Each operator against a brute-force version on awkward rows: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import decontaminate, html_extract, language_id, license_scan, minhash_dedup, packing, quality, substring_dedup, toxicity, warc
from lexmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, start int"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(2, 6)))
    base = [word() for _ in range(300)]
    passage = " ".join(base[:60])
    out = [None, "", " \n\t ", "one", "a b c", passage, "x " + passage + " y", passage + " " + passage, "w " * 200, "long" * 5000]
    out += [" ".join(r.choices(base, k=r.randint(1, 250))) for _ in range(30)]
    out += [" ".join(base), " ".join(base[:-3] + ["zz"]), " ".join(base), " ".join(["Q", *base]).upper().replace("É", "é")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    extra = [(None, texts[5], None, None, None, None, None), (3, "one", "en", "s", 3, "x", 1), (3, "other", "en", "s", 5, "x", 1)]
    return spark.createDataFrame(rows_of(texts) + extra, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(map(tuple, rows))


def brute_cut(all_texts, k=35):
    words = [(t or "").encode().split() for t in all_texts]
    n = collections.Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if n[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_substring_dedup(docs, empty):
    data = docs.select("doc_id", "text").collect()
    want = bag((r.doc_id, *c) for r, c in zip(data, brute_cut([r.text for r in data]), strict=True))
    assert bag(substring_dedup.substring_dedup(docs).collect()) == want
    kept = substring_dedup.substring_dedup(docs, with_text=True)
    assert set(kept.columns) == {*docs.columns, "n_words", "n_removed", "kept_text"} - {"text"}
    assert kept.count() == len(data)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_where_hashes_collide(spark):
    """With word hashes of four bits different passages share hashes; words at their coordinates tell them apart."""
    from lexmill.llm.common import NOT_SPACE, arrow_text, runs

    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
    by = collections.defaultdict(list)
    data, off = arrow_text(pa.array([" ".join(words)]))
    for w, h in zip(words, np.concatenate([x.hash for x in runs(data, off, NOT_SPACE)]).tolist(), strict=True):
        by[h & 15].append(w)
    kind = [r.choice(sorted(by)) for _ in range(90)]
    same = lambda: " ".join(r.choice(by[k]) for k in kind)
    a, b, c = same(), same(), same()
    texts = [a, b, "x y z " + a, c, " ".join(a.split()[:40] + b.split()[40:]), None, ""]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    want = bag((i, *x) for i, x in enumerate(brute_cut(texts)))
    assert bag(substring_dedup.substring_dedup(df, bits=4).collect()) == want
    assert bag(substring_dedup.substring_dedup(df).collect()) == want


def test_words_of_one_polynomial_hash(spark):
    """Thue-Morse words and their complements collide under every polynomial hash modulo 2**64; here they are two words."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = _said("w", 40).split()
    texts = [" ".join([*rest[:20], one, *rest[20:]]), " ".join([*rest[:20], two, *rest[20:]])]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    assert all(x.n_removed == 0 for x in substring_dedup.substring_dedup(df).collect())
    bench = spark.createDataFrame([(1, " ".join([*rest[15:20], one, *rest[20:24]]))], "item_id long, text string")
    assert [(x.doc_id, x.n_hit) for x in decontaminate.decontaminate(df, bench).orderBy("doc_id").collect()] == [(0, 10), (1, 0)]


def brute_sets(data):
    out = {}
    for r in data:
        w = (r.text or "").encode().lower().split()
        out[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_groups(data, percent=85):
    sets = []
    for r in data:
        w = (r.text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(data):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    out = []
    for i, r in enumerate(data):
        c = least.get(find(i)) if sets[i] else r.doc_id
        out.append((r.doc_id, len(sets[i]), c, r.doc_id == c))
    return out


def test_near_dedup(docs, empty):
    data = docs.select("doc_id", "text").collect()
    assert bag(minhash_dedup.near_dedup(docs).collect()) == bag(brute_groups(data))
    assert minhash_dedup.near_dedup(empty).count() == 0
    one = minhash_dedup.keep_one(docs)
    assert one.columns == docs.columns
    assert one.filter("doc_id = 3 and text = 'one'").count() == 1


def test_near_dedup_of_shared_passages(spark, monkeypatch):
    """Texts about 0.6 to 0.9 similar: buckets hold many components, so sketches are compared block by block."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 5)
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage = [word() for _ in range(300)]
    out = [" ".join(passage + [word() for _ in range(r.choice([10, 40, 60, 100, 200]))]) for _ in range(120)]
    out += [" ".join(t.split()[: -r.randint(1, 20)]) for t in out[:40]]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(out)], "doc_id long, text string").repartition(3)
    rows = data.collect()
    assert bag(minhash_dedup.near_dedup(data).collect()) == bag(brute_groups(rows))


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 2**63, 500).astype(np.uint64)])
    x, y = minhash_dedup.sketch(a, 384), minhash_dedup.sketch(b, 384)
    assert abs((x == y).mean() - 0.6) < 0.12
    assert (minhash_dedup.sketch(a[:1], 384) < np.iinfo(np.uint64).max).all()
    assert (minhash_dedup.sketch(a[:1], 384) == minhash_dedup.sketch(a[:1], 384)).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s or "")


def longest_at(w, p, tests):
    """Words of the longest match at p with any test suffix, if it reaches a window."""
    best = 0
    for v in tests:
        for j in range(len(v)):
            n = 0
            while p + n < len(w) and j + n < len(v) and w[p + n] == v[j + n]:
                n += 1
            if n >= min(10, len(v)):
                best = max(best, n)
    return best


def test_decontaminate(spark, docs, empty, texts):
    items = [(1, " ".join(texts[5].split()[20:45])), (2, "A B, c"), (3, None), (4, "!!"), (2, "A B, c"), (10, "nowhere to be found at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    data = docs.select("doc_id", "text").collect()
    want = []
    for r in data:
        w = ALNUM.findall(ascii_lower(r.text))
        hit, found = set(), set()
        for i, t in items:
            v = ALNUM.findall(ascii_lower(t))
            n = min(10, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[j : j + n]:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        best = max(((size, -p) for p in range(len(w)) for size in [longest_at(w, p, [ALNUM.findall(ascii_lower(t)) for _, t in items])] if size), default=(0, None))
        where = None if best[1] is None else -best[1]
        want.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), best[0], where))
    for block in (1 << 20, 20):
        assert bag(decontaminate.decontaminate(docs, bench, block_bytes=block).drop("spans").collect()) == bag(want)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    best = decontaminate.longest_matches(docs, bench).filter("item_id = '1'").agg({"n_words": "max"}).first()[0]
    assert best == 25


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
    out = packing.pack(docs, window=256).collect()
    assert sum(r.length for r in out) == sum(len(x) for v in ids.values() for x in v)
    for r in out:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_best_fit_is_tightest():
    r = random.Random(2)
    lengths = sorted((r.randint(1, 99) for _ in range(400)), reverse=True)
    sequence, _ = packing.best_fit(lengths, 100)
    rooms, want = [], []
    for n in lengths:
        fit = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if not fit:
            rooms.append(100)
            fit = [(100, len(rooms) - 1)]
        room = min(fit)[0]
        i = min(fit)[1]
        rooms[i] = room - n
        want.append(room - n)
    left = {}
    got = []
    for n, s in zip(lengths, sequence, strict=True):
        left[s] = left.get(s, 100) - n
        got.append(left[s])
    assert got == want


def test_encoder_equals_tokenizer():
    import public_tokenizers
    import pyarrow as pa

    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    r = random.Random(3)
    parts = ["'", "s", "'re", "ll", " ", "\n", "\x1c", "é", "É", "İ", "9", "½", "_", "!", "<|endoftext|>", "don't", "日本", "\xa0", "The"]
    cases = ["".join(r.choices(parts, k=r.randint(0, 20))) for _ in range(500)]
    for i, ids in e.column(pa.array(cases)):
        assert ids.tolist() == e.tokenizer.encode(cases[i], add_special_tokens=False).ids + [2]


def test_matcher_against_edit_distance():
    terms = [("idiot", False), ("worthless", False), ("lowei", True)]
    m = toxicity.Matcher(terms)

    def near(a, b):
        return abs(len(a) - len(b)) < 2 and (a == b or any(a[:i] + a[i + 1 :] == b or b[:i] + b[i + 1 :] == a or (len(a) == len(b) and a[:i] == b[:i] and a[i + 1 :] == b[i + 1 :]) for i in range(max(len(a), len(b)))))

    for w in ["idiot", "idiots", "idot", "iidiot", "idxot", "odxot", "worthles", "wrthless", "wothles", "loweiabc", "lowxiabc", "lowabc", "", "x"]:
        kind = m.kind(w)[0]
        exact = any(w == t or s and w.startswith(t) for t, s in terms)
        fuzzy = any(near(w, t) or s and any(near(w[:j], t) for j in range(len(w) + 1)) for t, s in terms)
        assert kind == (2 if exact else int(fuzzy)), w


def test_toxicity(spark, empty):
    r = random.Random(4)
    plain = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    data, labels = [], []
    for i in range(300):
        w = r.choices(plain, k=40)
        if i % 3 == 0:
            w[5], w[20], w[30] = "moronic", "scumbag", "moronic"
        data.append(" ".join(w))
        labels.append((i, int(i % 3 == 0), 1))
    docs = spark.createDataFrame(rows_of(data + [None, ""]), SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.held_out_scores(docs, marks).collect()
    assert len(got) == 302
    assert all(x.predicted == int(x.doc_id < 300 and x.doc_id % 3 == 0) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert toxicity.keep_clean(docs, marks).columns == docs.columns
    assert toxicity.held_out_scores(empty, marks.limit(0)).count() == 0


def test_language(spark, empty):
    r = random.Random(6)
    kinds = {"aa": ["the", "and", "ing", "er"], "bb": ["und", "ich", "ung", "sch"], "cc": ["que", "eau", "oux", "les"]}
    data = []
    for i in range(240):
        lang = list(kinds)[i % 3]
        data.append((i, " ".join("".join(r.choices(kinds[lang], k=3)) for _ in range(30)), lang))
    data += [(900, None, "aa"), (901, "12 34 !!", "aa"), (902, "", None), (903, "日本", "bb")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.held_out_languages(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in data[:240])
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[903].lang_pred != "und"
    assert language_id.held_out_languages(empty).count() == 0
    for k in (1, 2, 3, 5, 9):
        assert len({tuple(c) for c in language_id.codewords(k)}) == k


def test_seventy_languages(spark):
    r = random.Random(12)
    parts = {f"x{i:02d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)] for i in range(70)}
    data = [(i, " ".join("".join(r.choices(parts[f"x{i % 70:02d}"], k=2)) for _ in range(40)), f"x{i % 70:02d}") for i in range(70 * 12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    got = {x.doc_id: x for x in language_id.held_out_languages(docs).collect()}
    held = [i for i, _, _ in data if got[i].held_out]
    assert sum(got[i].lang_pred == f"x{i % 70:02d}" for i in held) >= 0.95 * len(held)
    assert len({got[i].lang_pred for i in held}) > 64


def test_language_reads_long_texts_in_blocks(monkeypatch):
    r = random.Random(31)
    texts = ["", "abc", None, " ".join("".join(r.choices("abcdefé ", k=6)) for _ in range(900)), "x", "12 ab"]
    data, off = language_id.arrow_text(pa.array(texts))
    x, bounds = language_id._padded(data, off, 0, len(texts))
    h, ok = language_id.trigrams(x)
    whole = [sorted(h[a:b][ok[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]
    for block in (3, 64, 5000):
        monkeypatch.setattr(language_id, "BLOCK", block)
        got = [[] for _ in texts]
        for part, at in language_id._blocks(data, off, 0, len(texts)):
            assert len(part) <= 2 * block + 2
            h, ok = language_id.trigrams(part)
            for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                got[i] += list(h[a:b][ok[a:b]])
        assert [sorted(g) for g in got] == whole


def test_quality(spark, docs, empty):
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.quality(docs, marks)
    data = docs.select("doc_id", "text").collect()
    want = []
    for r in data:
        t = r.text or ""
        w = [x.decode() for x in t.encode().split()]
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, dup = set(), 0
        for x in t.split("\n"):
            if x.encode().split():
                dup += x in lines
                lines.add(x)
        want.append((r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    assert bag(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == bag(want)
    assert got.filter("base_failed and kept").count() == 0
    assert quality.quality(empty, marks).count() == 0


def test_risk_control():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    sets = quality.design({("symbols_per_word", 10): (0, 500), ("symbols_per_word", 20): (900, 10), ("upper_share", 3): (10, 100)}, 3)
    assert sets == [{"symbols_per_word": 10}, {"symbols_per_word": 10, "upper_share": 3}]
    assert quality.certified(2, {0: 0, 1: 90}, 1000, 0.03, 0.05) == 1 and quality.certified(2, {1: 1}, 1000, 0.03, 0.05) == 2
    assert quality.certified(1, {}, 20, 0.03, 0.05) == 0


def test_quality_keeps_what_its_cutoffs_say(spark, empty):
    """70 strata; symbols mark bad documents in all but one; repeated labels and rows count once."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    data, marks = [], []
    for i in range(70 * 12 + 900):
        lang = f"l{i % 70}" if i < 840 else "big"
        good = i % 3 > 0
        words = [word() for _ in range(30)]
        if not good and lang != "l3":
            words = [w + "#$%" for w in words]
        data.append((i, " ".join(words), lang))
        marks += [(i, int(good))] * (10 if lang == "l5" else 1)
    docs = spark.createDataFrame(data + data[:50] + [(5000, None, None), (5001, "", "big")], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame(marks + [(None, 1)], "doc_id long, quality int")
    measured = quality.measure(docs)
    cutoffs = quality.calibrate(measured, labels)
    assert set(cutoffs) == {"big"}  # 8 good documents of a stratum prove nothing, nor do ten labels of each
    rows = {tuple(x[c] for c in ("doc_id", "lang")): x for x in measured.collect()}
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(data) + 52
    by_id = {d[0]: d[2] for d in data} | {5000: "none", 5001: "big"}
    for x in got:
        m = rows[x.doc_id, by_id[x.doc_id]]
        rejected = {rule for rule, c in cutoffs.get(m.lang, {}).items() if m[rule] > c}
        assert set(x.rejected_by) == rejected and x.kept == (not m.base_failed and not rejected)
    assert sum(not x.kept for x in got if by_id[x.doc_id] == "big") >= 300
    many = quality.calibrate(measured, labels, alpha=0.5, delta=70.0)
    assert len(many) > 50 and "l3" not in many


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>menu words here</a></nav>
<div class="ad">buy this now please</div><article><h1>Big &amp; bold</h1><p>First <b>par</b>agraph&nbsp;text  here.<br>More<p>Second one.
<div class="share">tweet</div></article><aside>side</aside><div id="comments">nice post</div><footer>&copy; foot"""


def test_html(spark):
    assert html_extract.extract(PAGE) == "Big & bold First paragraph text here. More Second one."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p>") == ""
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html_extract.main_text(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 54), (1, 54), (2, 0)]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_licenses(spark, empty):
    data = ["Hello there.\nLicensed under CC BY-NC 4.0.", "Released under the MIT License.", None, "", "the license plate was red", "All rights reserved.", "Licensed under CC BY-NC 4.0."]
    got = license_scan.scan(spark.createDataFrame(rows_of(data), SCHEMA)).collect()
    assert sorted((r.doc_id, r.family, r.confirmed) for r in got if r.confirmed) == [(0, "cc-by-nc", True), (1, "mit", True), (5, "all-rights-reserved", True), (6, "cc-by-nc", True)]
    assert license_scan.scan(empty).count() == 0


def test_warc(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    rec = [
        (1, "http://www.A.com/x/#f", 10, "response", "e1", None, None, {"Date": "1", "Content-Type": "h"}),
        (2, "https://a.com:443/x", 20, "response", "e2", None, None, {"Date": "2"}),
        (3, "a.com/x?utm_source=q", 15, "revisit", "W/e1", None, None, {"date": "9", "server": "s"}),
        (4, "a.com/x", 20, "revisit", "e1", None, None, None),
        (5, "a.com/x", 5, "revisit", "e1", None, None, None),
        (6, None, 5, "revisit", "e1", None, None, None),
        (7, "a.com/x", 99, "revisit", None, None, None, None),
    ]
    rec += [rec[0], (8, "a.com/X", 50, "revisit", "e2", None, None, None), (9, "https://A.com/X", 10**15, "response", "e9", None, None, None)]
    for width in (50_000, 3, 1):
        found = warc.resolve(spark.createDataFrame(rec, schema), width).collect()
        got = {r.record_id: r for r in found}
        assert sorted(r.record_id for r in found) == [3, 4, 5, 6, 7, 8] and got[8].response_id is None
        assert (got[3].response_id, got[3].resolved, got[3].headers) == (1, True, {"Content-Type": "h", "date": "9"})
        assert (got[4].response_id, got[4].resolved, got[4].headers) == (2, False, None)
        assert got[5].response_id is None and got[6].response_id is None and not got[7].resolved and got[7].response_id == 2


def test_warc_empty_and_repeats(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, r_ts long, url_key string"
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0
    r = random.Random(3)
    rec = [(i, r.choice(["a.com/x", "b.org", "", "c.d/" + "e" * 5000]), r.choice([r.randint(0, 60), 10**14]), r.choice(["response", "revisit"]), r.choice(["e", None]), None, None, None, 1, "k") for i in range(400)]
    data = spark.createDataFrame(rec + rec[:100], schema).repartition(3)
    want = collections.Counter()
    for x in rec + rec[:100]:
        if x[3] == "revisit":
            best = max(((y[2], y[0]) for y in rec if y[3] == "response" and y[1] == x[1] and y[2] <= x[2]), default=(None, None))
            want[x[0], best[1]] += 1
    for width in (50_000, 20, 1):
        assert collections.Counter((y.record_id, y.response_id) for y in warc.resolve(data, width).collect()) == want


def _said(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


@pytest.mark.parametrize("page", ["<body><article>%s</article><footer>f</footer>", "<body><nav>menu</nav><div>%s</div>"])
@pytest.mark.parametrize("box", ['<div class="ad">%s</div>', "<aside><p>%s</p></aside>", '<ul class="related"><li><a href=x>%s</a></ul>'])
def test_html_box_anywhere_cuts_only_itself(page, box):
    a, b, c, ad = _said("a", 200), _said("b", 30), _said("c", 3), box % _said("x", 25)
    for parts in ([ad, a, ad, b], [c, ad, a], [a, ad, b, ad, c], [c, ad, ad, b, ad, a, ad], [b, ad * 40, c]):
        body = "".join(p if p is ad or "<" in p else f"<p>{p}</p>" for p in parts)
        assert html_extract.extract(page % body) == " ".join(p for p in parts if "<" not in p)


def test_html_article_is_taken_whole():
    assert html_extract.extract(f"<article><h1>Lead</h1>{'<div><img></div>' * 50}<p>{_said('a', 40)}</p>{'<div><img></div>' * 50}<p>end</article>") == f"Lead {_said('a', 40)} end"


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar"><article><p>%s</article>',
        '<body class="sidebar"><div id="comments"><main><p>%s</p></main><nav>menu</nav></div>',
        '<div class="content no-banner"><article class="x"><p>%s</p></article></div>',
        '<article class="post comment-open widget"><p>%s</p></article><article class="related">teaser</article>',
        '<body class="has-sidebar"><div class="content no-banner"><p>%s</p></div><div class="sidebar">side</div>',
        '<body><nav>menu</nav><div class="widget"><h1>t0</h1><p>%s</p></div><div class="ad">buy</div>',
        '<div class="main-menu">one two</div><article><p>%s</article><div class="comments"><article>nice one</article></div><aside><article>%s</article></aside>',
    ],
)
def test_html_names_around_an_article_do_not_void_it(page):
    got = html_extract.extract(page.replace("%s", _said("a", 60)))
    assert got.removeprefix("t0 ") == _said("a", 60)


def test_html_learns_both_ways(spark):
    page = '<body class="sidebar"><nav>menu</nav><article><h1>t</h1><div class="widget"><p>%s</p><div class="ad">buy this</div></div></article><div class="zone">%s</div><div class="sidebar">%s</div>'
    rows = [(i, "u", page % (_said("a", 60), _said("z", 40), _said("s", 30))) for i in range(40)]
    df = spark.createDataFrame([*rows, (99, "u", f'<div class="widget">{_said("w", 20)}</div><div class="zone">z</div>')], "page_id long, url string, html string")
    names = html_extract.learn(df).names
    assert "widget" not in names and {"zone", "sidebar", "ad", "nav"} <= names
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got[0] == "t " + _said("a", 60) and got[99] == _said("w", 20)


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar home"><div><p>%s</p></div></body>',
        "<body><form id=aspnetForm><div class=page><p>%s</p></div></form></body>",
        '<body><nav>menu here</nav><div class="content related-none"><p>%s</p></div><p>&copy;</p></body>',
        '<body><div class="social widget"><div><p>%s</p></div></div>',
    ],
)
def test_html_wrappers_void_nothing(page):
    assert html_extract.extract(page % _said("a", 80)).startswith(_said("a", 80))


def test_best_region_is_the_greatest_sum():
    r = random.Random(13)
    for _ in range(300):
        scores = [r.choice([0, r.randint(-6, 6)]) for _ in range(r.randint(0, 12))]
        a, b = html_extract.best_region(scores)
        assert sum(scores[a:b]) == max(sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1))


def test_html_weights_come_from_marked_pages(spark):
    page = "<div><a>x y</a><a>z</a><a>v</a></div><article>" + "<p>%s</p>" * 3 + "</article><div><a>q</a></div>"
    df = spark.createDataFrame([(i, "u", page % ((_said("a", 30),) * 3)) for i in range(30)], "page_id long, url string, html string")
    model = html_extract.learn(df)
    assert model.word > 0 and model.tags["a"] < model.tags["p"] < 0 and model.tags["div"] < model.tags["p"]
    # Without a mark the learned weights find the region between the links.
    assert html_extract.extract("<i>k</i>" + "<a>l</a>" * 9 + f"<p>{_said('b', 40)}</p><p>c</p>" + "<a>m</a>" * 9, model) == _said("b", 40) + " c"
    assert html_extract.learn(df.limit(0)) == html_extract.PRIOR


@pytest.mark.parametrize(
    "around",
    [
        '<div class="overflow-hidden">%s</div>', '<div aria-hidden="false">%s</div>', '<a href="/hidden-gems">%s</a>', "<div hidden=until-found>%s</div>",
        '<div data-role="nav" data-hidden="x" title="display:none">%s</div>', '<svg class="i" d="a>b"/>%s', "<object data='a'/>%s", "<canvas />%s", "<svg/>%s<svg><text>no</text></svg>",
        "<svg-icon>%s</svg-icon>",
        '%s<p hidden>no</p>', '%s<p hidden="">no</p>', '%s<p aria-hidden=true>no</p>', '%s<p style="color:red; Display : none">no</p>', "%s<p HIDDEN>no</p>", "%s<svg><title>no</title></svg>",
    ],
)
def test_html_hidden_and_icons(around):
    assert html_extract.extract(f"<article><p>start</p>{around % _said('a', 9)}<p>end</article>") == f"start {_said('a', 9)} end"


def test_licenses_without_anchor_wrapped_and_many(spark):
    permission = "Permission is hereby granted, free\n# of charge, to any person obtaining\n# a copy of this software and associated\n# documentation files."
    data = [
        "Released under the GNU GPL, version 3.", "Distributed under the terms of the BSD 3-Clause.", "Released under Apache 2.0.", permission,
        "Some words before.\n\n" + permission.replace("\n", "\r\n") + "\r\n\r\nAll rights reserved.", "Released under the MIT License.\nReleased under the MIT License.",
        license_scan.NOTICES["apache-2.0"][1], "Der Hund. " * 300 + "\nLicensed under CC BY 4.0.\nNo stop here\nAll rights reserved.",
    ]
    got = collections.defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(rows_of(data), SCHEMA)).orderBy("doc_id", "segment").collect():
        got[r.doc_id].append((r.segment, r.family, r.confirmed))
    assert got[0] == [(0, "gpl-3.0", True)] and got[2] == [(0, "apache-2.0", True)] and [x[1] for x in got[1]] == ["bsd"]
    assert got[3] == [(0, "mit", True)] and got[4] == [(1, "mit", True), (5, "all-rights-reserved", True)]
    assert got[5] == [(0, "mit", True), (1, "mit", True)] and got[6] == [(0, "apache-2.0", True)]
    assert [x[1:] for x in got[7]][0] == ("cc-by", True) and ("all-rights-reserved", True) in [x[1:] for x in got[7]]


def test_licence_versions_and_families(spark):
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    data = {
        "This program is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0", lesser: "lgpl-2.1", "Licensed under the GNU General Public License, version 2.": "gpl-2.0",
        "Licensed under the GNU General Public License v3.0.": "gpl-3.0", "THE SOFTWARE IS PROVIDED AS IS": "mit", "CC0 1.0 Universal: the work is dedicated to the public domain.": "cc0-1.0",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted.": "isc",
        "He asked the general for permission to use the public road.": None, "The rights of the people are free under the law of the land.": None,
    }
    got = {r.doc_id: (r.family, r.confirmed) for r in license_scan.scan(spark.createDataFrame(rows_of(list(data)), SCHEMA)).collect()}
    assert [got.get(i) for i in range(len(data))] == [f and (f, True) for f in data.values()]


def test_very_long_texts(spark):
    """Texts far beyond a batch's share: each operator reads them whole."""
    r = random.Random(21)
    plain = ["".join(r.choices("abcdefghij", k=5)) for _ in range(3000)]
    long = " ".join(r.choices(plain, k=120_000))
    docs = spark.createDataFrame([(1, long + " scumbag", "en"), (2, "x y", "en"), (3, long + " scumbag", "en")], "doc_id long, text string, lang string").repartition(1)
    bench = spark.createDataFrame([(7, " ".join(long.split()[119_980:119_995]))], "item_id long, text string")
    hit = {x.doc_id: x for x in decontaminate.decontaminate(docs, bench).collect()}
    assert (hit[1].n_words, hit[1].n_hit, hit[1].longest_match, hit[1].longest_start) == (120_001, 15, 15, 119_980) and hit[2].n_hit == 0
    cut = {x.doc_id: x.n_removed for x in substring_dedup.substring_dedup(docs).collect()}
    assert cut == {1: 120_001, 2: 0, 3: 120_001}
    near = {x.doc_id: x for x in minhash_dedup.near_dedup(docs).collect()}
    assert near[3].component_id == 1 and near[1].n_shingles == 119_997
    measured = {x.doc_id: x for x in quality.measure(docs).collect()}
    assert measured[1].n_words == 120_001 and measured[1].word_chars == 120_000 * 5 + 7
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, marks).count() <= 3
    assert {x.lang_pred for x in language_id.identify(docs, language_id.learn(docs, docs.doc_id > 0)).collect()} == {"en"}
    assert license_scan.scan(spark.createDataFrame([(1, long + ". Released under the MIT License.")], "doc_id long, text string")).first().family == "mit"
    page = spark.createDataFrame([(1, "u", f"<article><p>{long}</p></article><footer>f</footer>")], "page_id long, url string, html string")
    assert html_extract.main_text(page).first().n_chars == len(long)


def test_sixteenfold_benchmark_words_in_bounded_memory():
    """A text of 80,000 benchmark words; the array's memory follows its words."""
    import tracemalloc

    from lexmill.llm.common import ALNUM as ALPHABET
    from lexmill.llm.common import arrow_text, runs

    r = random.Random(22)
    voc = [f"w{i}" for i in range(500)]
    items = [(str(i), " ".join(r.choices(voc, k=40))) for i in range(200)]
    test = decontaminate.TestSet([*items, ("x", "x " * 3000)], 10)
    for text in (" ".join(t for _, t in r.choices(items, k=2000)), "x " * 80_000):
        data, off = arrow_text(pa.array([text]))
        (w,) = runs(data, off, ALPHABET, lower=True)
        tracemalloc.start()
        matches = list(decontaminate.Shard(w, data, test).matches())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(matches) > 60_000 and peak < 300e6


def test_columns_of_any_name_keep_their_values(spark):
    """Stages and operators that carry columns: names that they use themselves come back with their own values."""
    import corpus_pipeline

    names = ["_k", "_h", "_c", "_c0", "_n", "_r", "_text", "score", "n_words", "n_removed", "spans", "items", "kept_text", "n_chars", "lot", "row", "cid"]
    r = random.Random(23)
    texts = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(60)) for _ in range(40)] + [None, ""]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    marks = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "nothing of that kind is here at all")], "item_id long, text string")
    want = bag(rows)
    for kept, repeats in ((toxicity.keep_clean(docs, marks), 2), (minhash_dedup.keep_one(docs), 1), (decontaminate.clean(docs, bench), 2)):
        assert kept.columns == docs.columns
        got = bag(kept.collect())
        assert got == want + (bag([rows[0]]) if repeats == 2 else bag([]))
    cut = corpus_pipeline.cut_repeats(spark, docs, None)
    assert cut.columns == docs.columns
    assert bag(x for x in cut.collect() if x.doc_id > 0) == bag(rows[1:])


def test_license_prefilter_is_sound():
    classes, weights, bias, _ = license_scan.train()
    need, none = license_scan.needed(classes, weights, bias), classes.index("none")
    for c in range(len(classes)):
        rest = sum(max(0.0, w[c] - w[none]) for g, w in weights.items() if g not in need)
        assert c == none or rest < bias[none] - bias[c]
    pattern = re.compile(license_scan._pattern(need))
    for g in need:
        assert pattern.search(" x . ".join(["", f"{g.replace(' ', '. ')}.", ""]))

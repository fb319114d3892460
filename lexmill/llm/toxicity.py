"""Toxicity: misspelled terms by a Levenshtein automaton intersected with a lexicon trie, then context-window scores.

Lexicon and weights are learned from labelled rows only.  Terms are whole words or stems (a stem matches a word's
beginning) that are frequent in documents marked toxic and rare in others; of a chain of nested stems with the same
support the longest is kept.  The trie of terms is run together with the automaton of words within one edit; the product
automaton is made deterministic on the fly, so a word costs a table look-up for each character and most words die after
three or four.  Around each hit a window of words is scored: quotation marks about it, other hits near it.  A document's
score is a logistic function of its hits, near hits, density, quoted share, clusters and distinct terms.

Learning uses a bounded sample of ``sample`` rows of each label (least hash of the id; every row if there are fewer); how
many terms can reach the least support in it is bounded by it, and all that do are terms.  A word of over ``LONG_WORD``
letters is counted whole, without its stems.

Null and empty texts score as texts without hits; long texts are read whole.  Labels of value null are not learned from, an
id with several labels has the greatest, an id with several texts the least.  Rows that repeat are scored alike, each.
Without both labels in the sample nothing is learned and every score is the share of toxic labels seen (0 if none).  An
empty table gives an empty result.  Other columns of any name are left out by ``held_out_scores`` and kept as they are by
``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import NOT_SPACE, arrow_text, fold, mix, ready, rows_where, runs, signed, slices, staged, with_columns_aside
from lexmill.llm.minhash_dedup import shingle_sets

SAMPLE, WINDOW, FOLDS = 2000, 8, 5
MIN_STEM, LONG_WORD, MIN_SUPPORT, SUPPORT_SHARE, PURITY = 4, 64, 4, 0.02, 0.85
#: Terms of this many letters or more also match within one edit.
FUZZY_LETTERS = 5
WORD = re.compile(r"[^\W\d_]+")
OPENERS, CLOSERS = set("\"«“„‘‹「"), set("\"»”“’›」")
FEATURES = 7
#: Words whose kind a task remembers.
KNOWN = 1 << 17


class Matcher:
    """The trie of (term, is_stem) times the automaton of one edit, determinised lazily.

    A state is a set of (trie node, edits).  ``kind(word)``: 0 none, 1 within one edit, 2 exact; with the term's number.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.end: list[tuple[int, bool] | None] = [None]
        for i, (term, stem) in enumerate(terms):
            node = 0
            for ch in term:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.end.append(None)
                node = self.child[node][ch]
            self.end[node] = (i, stem)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.known: dict[str, tuple[int, int]] = {}
        self.root = self._state(self._close({(0, 0)}))

    def _close(self, items: set) -> frozenset:
        """With skipped letters of the term (one edit)."""
        out = set(items)
        for node, e in items:
            if e == 0:
                out.update((c, 1) for c in self.child[node].values())
        return frozenset(out)

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.next.append({})
        return self.states[s]

    def _step(self, state: int, ch: str) -> int:
        out: set = set()
        for node, e in self.sets[state]:
            if node in (-1, -2):  # a stem was matched: the rest of the word is free
                out.add((node, e))
                continue
            found = self.child[node].get(ch)
            if found is not None:
                out.add((found, e))
            if e == 0:
                out.add((node, 1))
                out.update((c, 1) for c in self.child[node].values())
        return self._state(self._close(out))

    def kind(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            got = self._run(word)
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[word] = got
        return got

    def _run(self, word: str) -> tuple[int, int]:
        state, best = self.root, (0, -1)
        for i, ch in enumerate(word):
            to = self.next[state].get(ch)
            if to is None:
                to = self.next[state][ch] = self._step(state, ch)
            state = to
            if not self.sets[state]:
                return best
            best = max(best, self._ends(state, i + 1 == len(word)))
        return best

    def _ends(self, state: int, last: bool) -> tuple[int, int]:
        best = (0, -1)
        for node, e in self.sets[state]:
            end = self.end[node]
            if end is not None and (last or end[1]) and (e == 0 or len(self.terms[end[0]][0]) >= FUZZY_LETTERS):
                best = max(best, (2 - e, end[0]))
        return best


def features(text: str | None, matcher: Matcher, window: int) -> list[float]:
    """1, exact hits, near hits, their density, unquoted share, clustered share, distinct terms."""
    text = text or ""
    words = WORD.findall(text.lower())
    kinds = list(map(matcher.kind, words))
    hits = [i for i, k in enumerate(kinds) if k[0]]
    if not hits:
        return [1.0] + [0.0] * (FEATURES - 1)
    exact = sum(kinds[i][0] == 2 for i in hits)
    near = len(hits) - exact
    quoted = 0
    if any(c in text for c in OPENERS):
        # Words inside a pair of marks no further apart than two windows count as quoted.
        inside, at, opened = [], 0, -1
        for m in re.finditer(r"[^\W\d_]+|[\"«»“”„‘’‹›「」]", text):
            if m[0] in OPENERS and opened < 0:
                opened = at
            elif m[0] in CLOSERS and opened >= 0:
                if at - opened <= 2 * window:
                    inside.append((opened, at))
                opened = -1
            elif m[0][0].isalpha():
                at += 1
        quoted = sum(any(a <= i < b for a, b in inside) for i in hits)
    clustered = sum(1 for a, b in zip(hits, hits[1:], strict=False) if b - a <= window)
    n = len(hits)
    return [1.0, math.log1p(exact), math.log1p(near), min(1.0, 20.0 * n / len(words)), (n - quoted) / n, clustered / n, math.log1p(len({kinds[i][1] for i in hits}))]


class Scorer:
    """Scores columns of texts in one task; what it remembers of words goes with the task."""

    def __init__(self, shared, window: int):
        (self.matcher, self.weights), self.window = shared.value, window
        self.matcher.known.clear()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        x = np.array([features(t.as_py(), self.matcher, self.window) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _score_batches(shared, window: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared, window)
        for batch in batches:
            for b in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(scorer(b.column("text")))], names=[*columns, "score"])
        scorer.matcher.known.clear()

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, whole, toxic, n): documents of the batch that hold each word, and each beginning of a word."""
    for b in batches:
        seen: Counter = Counter()
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            words = set(WORD.findall((text.as_py() or "").lower()))
            grams = {(w, True) for w in words if len(w) >= MIN_STEM}
            grams |= {(w[:j], False) for w in words if len(w) <= LONG_WORD for j in range(MIN_STEM, len(w) + 1)}
            for g in grams:
                seen[(*g, toxic)] += 1
        keys = list(seen)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["gram", "whole", "toxic", "n"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least hashes of five-word runs under four orders: copies agree on one or more of them."""
    for b in batches:
        data, off = arrow_text(b.column("text"))
        sig = np.zeros((b.num_rows, 4), np.int64)
        for w in runs(data, off, NOT_SPACE, lower=True):
            for i, s in enumerate(shingle_sets(w, 5)):
                if len(s):
                    sig[w.lo + i] = [signed(mix(s, 20 + j)).min() for j in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(sig), pa.list_(pa.int64()))], names=["doc_id", "sig"])


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows of each label, without copies; staged.

    Only ids, labels and signatures of the sample come to the driver, so at most 2 * sample short rows.
    """
    spark = ready(docs.sparkSession)
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(learn)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [rows.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    marks = {r.doc_id: r.toxic for p in picked for r in p.collect()}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = spark.createDataFrame(list(marks.items()), f"doc_id {id_type}, toxic int")
    # An id that repeats comes once, combined before the shuffle.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    texts = staged(texts, "labelled")
    seen: set = set()
    kept = []
    for r in sorted(texts.select("doc_id", "text").mapInArrow(_signatures, f"doc_id {id_type}, sig array<long>").collect(), key=lambda r: (r.doc_id, r.sig)):
        own = {(j, v) for j, v in enumerate(r.sig) if v}
        if not own & seen:
            kept.append((r.doc_id,))
        seen |= own
    single = spark.createDataFrame(kept, f"doc_id {id_type}")
    return texts.join(F.broadcast(single), "doc_id").select("text", "toxic")


def mine_terms(rows: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems of toxic documents; as many come to the driver as reach the support in the sample."""
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return []
    support = max(MIN_SUPPORT, math.ceil(SUPPORT_SHARE * n[1]))
    counts = rows.mapInArrow(_grams, "gram string, whole boolean, toxic int, n long").groupBy("gram", "whole").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")
    )
    # Compared as rates, so the share of toxic rows in the sample does not matter.
    rate = F.col("bad") / n[1]
    found = counts.filter((F.col("bad") >= support) & (rate >= PURITY * (rate + F.col("good") / n[0]))).collect()
    return chained({r.gram: r.bad for r in found if not r.whole}, {r.gram: r.bad for r in found if r.whole})


def chained(stems: dict[str, int], words: dict[str, int]) -> list[tuple[str, bool]]:
    """(term, is_stem) of grams with their support: of each chain of stems the longest that keeps it, then other words."""
    longer: dict[str, list[str]] = {}
    for g in stems:
        longer.setdefault(g[:-1], []).append(g)
    terms: list[tuple[str, bool]] = []
    taken: set[str] = set()
    passed: set[str] = set()

    def begun(gram: str) -> bool:
        return any(gram[:j] in taken for j in range(MIN_STEM, len(gram) + 1))

    for gram, bad in sorted(stems.items(), key=lambda x: (len(x[0]), x[0])):
        if gram in passed or begun(gram):
            continue
        # Follow the only continuation as far as it keeps the support.
        at = gram
        while then := next((g for g in longer.get(at, ()) if stems[g] >= 0.9 * bad), None):
            passed.add(then)
            at = then
        is_stem = words.get(at, 0) < 0.9 * bad
        terms.append((at, is_stem))
        if is_stem:
            taken.add(at)
    whole = {t for t, is_stem in terms if not is_stem}
    terms += [(w, False) for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])) if w not in whole and not begun(w)]
    return terms


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, rows: Column, sample: int = SAMPLE, window: int = WINDOW) -> tuple[Matcher, np.ndarray]:
    spark = docs.sparkSession
    training = sampled(docs, labels, rows, sample)
    terms = mine_terms(training)
    matcher = Matcher(terms)
    shared = spark.sparkContext.broadcast(matcher)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), shared.value, window) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

    got = training.mapInArrow(extract, "x array<double>, toxic int").collect()  # at most 2 * sample short rows
    y = np.array([r.toxic for r in got], float)
    if not len(y) or y.min() == y.max():
        weights = np.zeros(FEATURES)
        weights[0] = 30.0 if len(y) and y[0] == 1 else -30.0
        return matcher, weights
    return matcher, fit_logistic(np.array([r.x for r in got]), y)


def score(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, carry: list[str] | None = None, sample: int = SAMPLE, window: int = WINDOW) -> DataFrame:
    """The carried columns (doc_id by default) and score of every row."""
    carry = ["doc_id"] if carry is None else carry
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, F.lit(True) if learn_from is None else learn_from, sample, window))
    aside, names, types = with_columns_aside(docs, carry)
    out = docs.select("text", *aside).mapInArrow(_score_batches(model, window, names), f"{types}, score double")
    return out.toDF(*carry, "score")


def held_out_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows outside the held-out fold only."""
    scored = score(docs, labels, fold("doc_id", FOLDS) != 0, **options)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, window: int = WINDOW) -> DataFrame:
    """Rows of docs that score under 0.5, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, F.lit(True), sample, window))

    def judge():
        scorer = Scorer(model, window)
        return lambda texts: scorer(texts) < 0.5

    return rows_where(docs, judge)

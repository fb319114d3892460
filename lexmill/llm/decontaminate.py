"""Benchmark decontamination with suffix arrays over shards of the training text.

Every task cuts its texts into shards of about a megabyte.  Words of a shard that no test window can cover (their windows'
hashes are in none of the tests) cannot be part of a match and are left out; what remains are short stretches in which
words are compared with the tests' words byte by byte, so a match never rests on a hash.  Over the stretches a suffix array
is built by prefix doubling, in memory linear in the words.  Every test suffix whose first window may occur is
binary-searched in it: the range of its first ``window`` words gives all places where the window occurs, and a place whose
word before differs from the suffix's is followed to the end, which gives each longest verbatim match once, with its
location.  The documents are never shuffled; what a shard costs grows with its own words, and with the tests' size by the
logarithm of a look-up only.

The benchmark goes to the tasks as a broadcast of checked size: items are taken in blocks of at most ``block_bytes`` of
text (one item at least); with more than one block each block is a pass of its own and the passes' hits are merged by row.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is ``window`` consecutive words of an item,
or the whole item if it has fewer (an item without words has none).  Null and empty texts have no words.  Very long texts
are shards of their own.  Repeated items count once by id; items of null id take part under the empty id.  Rows of
documents that repeat are each reported.  Of equally long matches of a document the first counts.  Empty tables, of
documents or tests, give no hits.  Other columns of any name are left out by ``decontaminate`` and kept as they are by
``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ALNUM, U, Words, arrow_text, mix, ready, rows_where, runs, slices, spans_hash, staged, with_columns_aside

WINDOW, BLOCK_BYTES = 10, 8 << 20
#: Words that are compared in one numpy step.
CELLS = 1 << 20
_BASE = 0x9FB21C651E98DF25 | 1


def _window_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return mix(spans_hash(hashes, at, at + n, _BASE), n)


class TestSet:
    """Items as numbers of a vocabulary, one after the other, and where each distinct window hash begins in them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [t.encode() for _, t in items]
        off = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        w = Words(data, off, 0, len(items), ALNUM, True)
        self.window, self.ids, self.item, self.first = window, [i for i, _ in items], w.doc, w.first
        self.vocabulary, at, number = np.unique(w.hash, return_index=True, return_inverse=True)
        self.words = [data[w.start[i] : w.end[i]].tobytes().lower() for i in at]
        # A word that shares its hash with another one gets a number of its own.
        known = {x: i for i, x in enumerate(self.words)}
        self.twins: dict[bytes, int] = {}
        for i in range(len(w)):
            raw = data[w.start[i] : w.end[i]].tobytes().lower()
            if raw != self.words[number[i]]:
                number[i] = self.twins.setdefault(raw, len(known) + len(self.twins))
        #: Words as big-endian numbers, so that their bytes compare as they do.
        self.text = number.astype(">i4")
        self.raw = self.text.tobytes()
        #: Words of a window -> (sorted window hashes, bounds of the positions of each, positions).
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.diff(w.first)
        least = np.minimum(sizes, window)[w.doc] if len(w) else np.empty(0, np.int64)
        left = w.first[w.doc + 1] - np.arange(len(w)) if len(w) else np.empty(0, np.int64)
        for n in np.unique(least).tolist():
            places = np.flatnonzero((least == n) & (left >= n))
            keys = _window_hashes(w.hash, places, n)
            order = np.argsort(keys, kind="stable")
            found, begin = np.unique(keys[order], return_index=True)
            self.windows[n] = (found, np.append(begin, len(order)), places[order])

    def number(self, hashes: np.ndarray, raw: Iterator[bytes]) -> np.ndarray:
        """Numbers of words by hash and by their own bytes; -1 for those that no item has."""
        at = np.searchsorted(self.vocabulary, hashes)
        out = []
        for i, word in zip(at.tolist(), raw, strict=True):
            out.append(i if i < len(self.words) and self.words[i] == word else self.twins.get(word, -1))
        return np.array(out, np.int64)


def suffix_ranks(numbers: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rank of the words from each position to the end of its stretch, ``left`` words on; equal ones share a rank."""
    rank, step, kinds = np.unique(numbers, return_inverse=True)[1] + 1, 1, -1
    while True:
        then = np.zeros(len(rank), np.int64)
        then[:-step or None] = rank[step:]
        then[left <= step] = 0
        found, rank = np.unique(rank * (len(rank) + 2) + then, return_inverse=True)
        rank = rank + 1
        if len(found) == kinds or len(found) == len(rank):
            return rank
        kinds, step = len(found), 2 * step
        if step >= len(rank):
            return rank


class Match(NamedTuple):
    """A place (word of the run), the words of the window that begins there, items that hold it, the longest match there."""

    place: int
    n: int
    items: set[int]
    longest: int


class Shard:
    """The suffix array of those words of one block of texts that test windows may cover."""

    def __init__(self, words: Words, data: np.ndarray, test: TestSet):
        self.test, n = test, len(words)
        covered = np.zeros(n + 1, np.int64)
        self.asked: dict[int, np.ndarray] = {}
        candidates: dict[int, np.ndarray] = {}
        for size, (keys, _, _) in test.windows.items():
            at = np.arange(max(0, n - size + 1))
            at = at[words.doc[at] == words.doc[at + size - 1]]
            hashes = _window_hashes(words.hash, at, size)
            slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            same = keys[slot] == hashes
            self.asked[size], candidates[size] = np.unique(slot[same]), at[same]
            np.add.at(covered, at[same], 1)
            np.add.at(covered, at[same] + size, -1)
        #: Words of the run that are kept, in order; the stretch of each ends where the next one kept is not its neighbour.
        self.kept = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        if not len(self.kept):
            self.array = np.empty(0, np.int64)
            return
        k = self.kept
        number = test.number(words.hash[k], (data[s:e].tobytes().lower() for s, e in zip(words.start[k].tolist(), words.end[k].tolist(), strict=True)))
        ends = np.ones(len(k), bool)
        ends[:-1] = (k[1:] != k[:-1] + 1) | (words.doc[k[1:]] != words.doc[k[:-1]])
        stop = np.where(ends | (number < 0), np.arange(1, len(k) + 1), len(k))
        self.stop = np.minimum.accumulate(stop[::-1])[::-1]
        self.text, self.raw = number, number.astype(">i4").tobytes()
        self.before = np.append(-1, np.where(ends[:-1], -1, number[:-1]))
        self.rank = suffix_ranks(number, self.stop - np.arange(len(k)))
        places = np.unique(np.searchsorted(k, np.concatenate(list(candidates.values()))))
        places = places[number[places] >= 0]
        self.array = places[np.argsort(self.rank[places], kind="stable")]

    def _key(self, i: int, size: int) -> bytes:
        p = int(self.array[i])
        return self.raw[4 * p : 4 * min(p + size, int(self.stop[p]))]

    def _search(self, probe: bytes, upper: bool) -> int:
        """First index whose suffix, cut to the probe's length, is >= (upper: >) the probe."""
        lo, hi, size = 0, len(self.array), len(probe) // 4
        while lo < hi:
            mid = (lo + hi) // 2
            key = self._key(mid, size)
            if key < probe or upper and key == probe:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def _suffixes(self) -> Iterator[tuple[list[int], int, int, int]]:
        """(positions in the tests of the suffixes with one window, words of it, range of the array) of each that occurs."""
        for size, slots in self.asked.items():
            _, bounds, positions = self.test.windows[size]
            for slot in slots.tolist():
                alike: dict[bytes, list[int]] = {}
                for q in positions[bounds[slot] : bounds[slot + 1]].tolist():
                    alike.setdefault(self.test.raw[4 * q : 4 * (q + size)], []).append(q)
                for probe, qs in alike.items():
                    lo, hi = self._search(probe, False), self._search(probe, True)
                    if lo < hi:
                        yield qs, size, lo, hi

    def _follow(self, places: np.ndarray, q: int, size: int) -> np.ndarray:
        """Words that each place and the test suffix at q, equal for ``size`` words, have in common."""
        test, end = self.test, int(self.test.first[self.test.item[q] + 1])
        out, live, step = np.full(len(places), size), np.arange(len(places)), 16
        while len(live):
            n = min(step, end - q - size, max(1, CELLS // len(live)))
            if n <= 0:
                break
            at = places[live][:, None] + size + np.arange(n)
            inside = at < self.stop[places[live]][:, None]
            same = inside & (self.text[np.minimum(at, len(self.text) - 1)] == test.text[q + size : q + size + n].astype(np.int64))
            run = np.where(same.all(1), n, same.argmin(1))
            out[live] += run
            live, size, step = live[run == n], size + n, 2 * step
        return out

    def matches(self) -> Iterator[Match]:
        """Every window that occurs at every place; longest matches are given where they begin, else the window's words."""
        if not len(self.array):
            return
        found: dict[tuple[int, int], tuple[set[int], int]] = {}
        for qs, size, lo, hi in self._suffixes():
            places, items = self.array[lo:hi], {int(self.test.item[q]) for q in qs}
            before, longest = self.before[places], np.full(hi - lo, size)
            for q in qs:
                # A match that could begin a word earlier is part of a longer one.
                fresh = np.ones(len(places), bool) if q == self.test.first[self.test.item[q]] else before != int(self.test.text[q - 1])
                if fresh.any():
                    longest[fresh] = np.maximum(longest[fresh], self._follow(places[fresh], q, size))
            for p, n in zip(places.tolist(), longest.tolist(), strict=True):
                found[p, size] = items, n
        for (p, size), (items, best) in sorted(found.items(), key=lambda x: x[0]):
            yield Match(int(self.kept[p]), size, items, best)

    def longest(self) -> Iterator[tuple[int, int, int, int]]:
        """(item, offset in it, place, words): the longest verbatim match of each test suffix that has one, the first of these."""
        if not len(self.array):
            return
        for qs, size, lo, hi in self._suffixes():
            for q in qs:
                n, item = self._follow(self.array[lo:hi], q, size), int(self.test.item[q])
                best = int(n.max())
                yield item, q - int(self.test.first[item]), int(self.kept[self.array[lo:hi][n == best].min()]), best


FOUND = "n_words long, spans array<int>, items array<string>, longest_match long, longest_start long"


def _pass(shared):
    """Per row: n_words, hit spans (first word, words) flattened, item ids, words and start of the longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        for batch in batches:
            for b in slices(batch, batch.schema.get_field_index("text")):
                data, off = arrow_text(b.column("text"))
                others = [n for n in b.schema.names if n != "text"]
                n_words, spans, items, best = [], [], [], []
                for w in runs(data, off, ALNUM, lower=True):
                    rows = w.hi - w.lo
                    hit: list[list[int]] = [[] for _ in range(rows)]
                    found: list[set[str]] = [set() for _ in range(rows)]
                    longest: list[tuple[int, int]] = [(0, 0)] * rows
                    for m in Shard(w, data, test).matches():
                        r = int(w.doc[m.place])
                        start = m.place - int(w.first[r])
                        hit[r] += [start, m.n]
                        found[r].update(test.ids[i] for i in m.items)
                        longest[r] = max(longest[r], (m.longest, -start))
                    n_words += np.diff(w.first).tolist()
                    spans += hit
                    items += [sorted(x) for x in found]
                    best += longest
                cols = [b.column(n) for n in others] + [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                cols += [pa.array([n for n, _ in best], pa.int64()), pa.array([-s if n else None for n, s in best], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*others, "n_words", "spans", "items", "longest_match", "longest_start"])

    return run


DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_start long, spans array<int>"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_hit, digest = [], []
        for spans, items in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
            covered = 0
            if spans:
                pairs, end = sorted(zip(spans[::2], spans[1::2], strict=True)), 0
                for s, n in pairs:
                    covered += max(0, s + n - max(end, s))
                    end = max(end, s + n)
            n_hit.append(covered)
            digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        cols = [b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in b.column("items")], pa.int64()), pa.array(digest)]
        cols += [pa.array([n > 0 for n in n_hit]), b.column("longest_match"), b.column("longest_start"), b.column("spans")]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_start", "spans"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time; one block at least."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").filter("text is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.text.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.text))
        size += n
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The carried columns of every row, then n_words, spans, items, longest_match and longest_start."""
    spark = ready(docs.sparkSession)
    aside, names, types = with_columns_aside(docs, carry)
    text = F.col("text").alias("text")
    fields = [f.split()[0] for f in FOUND.split(", ")]
    results = []
    blocks = _blocks(benchmark, block_bytes)
    block, more = next(blocks), None
    while True:
        more = next(blocks, None)
        shared = spark.sparkContext.broadcast(TestSet(block, window))
        if not results and more is None:
            return docs.select(text, *aside).mapInArrow(_pass(shared), f"{types}, {FOUND}").toDF(*carry, *fields)
        keyed = docs.select(F.xxhash64("doc_id", "text").alias("_k"), F.hash("text", "doc_id").alias("_h"), "text")
        hits = keyed.mapInArrow(_pass(shared), f"_k long, _h int, {FOUND}").filter("size(spans) > 0")
        results.append(staged(hits.dropDuplicates(["_k", "_h"]), "hits"))
        if more is None:
            break
        block = more
    hits = results[0]
    for r in results[1:]:
        hits = hits.unionByName(r)
    best = F.max(F.struct("longest_match", (-F.col("longest_start")).alias("s"))).alias("_b")
    merged = hits.groupBy("_k", "_h").agg(F.flatten(F.collect_list("spans")).alias("_s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_i"), best)
    empty = spark.sparkContext.broadcast(TestSet([], window))
    keys = docs.select(text, *aside, F.xxhash64("doc_id", "text").alias("_k"), F.hash("text", "doc_id").alias("_h"))
    counted = keys.mapInArrow(_pass(empty), f"{types}, _k long, _h int, {FOUND}").drop("spans", "items", "longest_match", "longest_start")
    joined = counted.join(merged, ["_k", "_h"], "left")
    lists = [F.coalesce("_s", F.array().cast("array<int>")), F.coalesce("_i", F.array().cast("array<string>"))]
    return joined.select(*names, "n_words", *lists, F.coalesce("_b.longest_match", F.lit(0).cast("long")), (-F.col("_b.s")).alias("at")).toDF(*carry, *fields)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words of the longest verbatim match of
    a test suffix, 0 if none), longest_start (its first word), spans (first word and words of each occurrence)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return scan(docs, benchmark, ["doc_id"], window, block_bytes).mapInArrow(_digest, f"doc_id {id_type}, {DIGEST}")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without any occurrence, with their columns; a pass for each block of tests, no join."""
    spark = ready(docs.sparkSession)
    out = docs
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(TestSet(block, window))

        def judge(shared=shared):
            def mask(texts: pa.Array) -> np.ndarray:
                data, off = arrow_text(texts)
                keep = np.ones(len(texts), bool)
                for w in runs(data, off, ALNUM, lower=True):
                    for m in Shard(w, data, shared.value).matches():
                        keep[w.lo + int(w.doc[m.place])] = False
                return keep

            return mask

        out = rows_where(out, judge)
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, item_offset, doc_id, doc_offset, n_words: for each shard and test suffix, its longest verbatim match."""
    spark = ready(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(shared):
        def run(batches):
            test = shared.value
            for b in batches:
                data, off = arrow_text(b.column("text"))
                ids = b.column("doc_id").to_pylist()
                for w in runs(data, off, ALNUM, lower=True):
                    rows = [(test.ids[i], j, ids[w.lo + int(w.doc[p])], int(p - w.first[w.doc[p]]), n) for i, j, p, n in Shard(w, data, test).longest()]
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                    kinds = [pa.string(), pa.int32(), b.schema.field("doc_id").type, pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "item_offset", "doc_id", "doc_offset", "n_words"])

        return run

    out = None
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(TestSet(block, window))
        part = docs.select("doc_id", "text").mapInArrow(make(shared), f"item_id string, item_offset int, doc_id {id_type}, doc_offset int, n_words int")
        out = part if out is None else out.unionByName(part)
    return out

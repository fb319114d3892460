"""Substring deduplication by a compacted de Bruijn graph of word windows.

A window of ``window`` words is an edge of the de Bruijn graph (its nodes are the runs one word shorter).  Edges are
never shuffled one by one.  Every window has a minimizer, the smallest-hashed ``anchor`` words in it; consecutive
windows of a document that share it form a *segment*, which depends on local text only, so a repeated stretch of text
splits into the same segments wherever it stands.  Then

1. anchors are counted (map-side combined), and segments of a repeated anchor are kept by a join;
2. segments with an equal copy are repeated as a whole.  A segment passes every time it occurs to the same next one that
   occurs no more often: then the way from one to the other does not branch.  Joins of neighbours and pointer doubling
   compact such ways into paths, which occur as a whole wherever they occur;
3. the rest, at the ends of repeats where paths branch, are opened into windows, once for each distinct segment,
   and windows are matched by a join;
4. source coordinates (row key, first word, number of windows) of paths and windows become covered spans of each row;
5. the words at these coordinates are compared: each occurrence of a path or window is digested from its own words
   (BLAKE2b, 128 bits).  Where the digests of one path differ, a 64-bit hash has collided: that path is opened
   into windows, and only those whose words recur in it are cut.

A row whose text is null, empty or shorter than the window is never cut.  Very long texts are read whole.  Rows that repeat
(same id, same text) are documents of their own and repeat each other.  Of ties nothing depends on order.  Null ids and
further columns are allowed; what these are named does not matter, unless the result's own columns have the name.  An empty
table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import (
    NOT_SPACE,
    U,
    Words,
    arrow_text,
    dropped,
    mix,
    ready,
    runs,
    signed,
    slices,
    sliding_argmin,
    spans_hash,
    staged,
    windows_hash,
    with_columns_aside,
    with_row_key,
)

WINDOW, ANCHOR = 35, 10
_SEG_BASE, _WIN_BASE = 0xA0761D6478BD642F | 1, 0xE7037ED1A0B428DB | 1


def _segments(words: Words, window: int, anchor: int):
    """Arrays first word, number of windows, anchor hash, hash of the whole segment; words are numbered in the run."""
    n = len(words) - window + 1
    if n <= 0:
        return None
    grams = mix(windows_hash(words.hash, anchor), 1)
    at = sliding_argmin(grams, window - anchor + 1)
    p = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    if not len(p):
        return None
    m = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    start, count = p[head], np.diff(np.append(head, len(p)))
    whole = mix(spans_hash(words.hash, start, start + count + window - 1, _SEG_BASE), 2)
    return start, count, grams[m[head]], whole


def _words(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batch with their words; hashes of words are cut to so many bits (fewer than 64 in tests only)."""
    for b in slices(batch, batch.schema.get_field_index("text")):
        data, off = arrow_text(b.column("text"))
        for w in runs(data, off, NOT_SPACE):
            if bits < 64:
                w.hash &= U((1 << bits) - 1)
                w.hash = mix(w.hash)
            yield b, w


def _segment_batches(window: int, anchor: int, only_anchor: bool, bits: int):
    names = ["m"] if only_anchor else ["_k", "_h", "start", "n", "m", "s", "next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, w in _words(batch, bits):
                found = _segments(w, window, anchor)
                if found is None:
                    continue
                start, count, m, s = found
                cols = [pa.array(signed(m))]
                if not only_anchor:
                    row = w.doc[start]
                    own = w.lo + row
                    last = np.append(row[1:] != row[:-1], True)
                    k, h = b.column("_k").to_numpy()[own], b.column("_h").to_numpy()[own]
                    cols = [pa.array(x) for x in (k, h, (start - w.first[row]).astype(np.int32), count.astype(np.int32), signed(m), signed(s))]
                    cols.append(pa.array(np.append(signed(s)[1:], 0), mask=last))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _open_windows(window: int, bits: int):
    """Windows of the listed segments of each row: (_k, _h, p, single, m, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, w in _words(batch, bits):
                lists = b.column("segs")
                bounds = lists.offsets.to_numpy()
                flat = lists.values
                a, z = int(bounds[w.lo]), int(bounds[w.hi])
                if a == z:
                    continue
                row = np.repeat(np.arange(w.lo, w.hi), np.diff(bounds[w.lo : w.hi + 1]))
                start, count = flat.field("start").to_numpy()[a:z], flat.field("n").to_numpy()[a:z].astype(np.int64)
                m, single = flat.field("m").to_numpy()[a:z], flat.field("single").to_numpy(zero_copy_only=False)[a:z]
                each = np.repeat(np.arange(z - a), count)
                inner = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                p = start[each] + inner
                at = w.first[row - w.lo][each] + p
                hashed = mix(spans_hash(w.hash, at, at + window, _WIN_BASE), 3)
                own = row[each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (b.column("_k").to_numpy()[own], b.column("_h").to_numpy()[own], p.astype(np.int32), single[each], m[each], signed(hashed))],
                    names=["_k", "_h", "p", "single", "m", "w"],
                )

    return run


def _joined(spans: list[dict]) -> list[tuple[int, int, int]]:
    """(path, start, windows): neighbouring segments of a path put together; each of its occurrences begins with its head."""
    out: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    for x in sorted(spans, key=lambda x: (x["start"], x["n"])):
        at = open_at.get(x["path"])
        if at is not None and not x["head"] and at[1] + at[2] == x["start"]:
            at[2] += x["n"]
        else:
            open_at[x["path"]] = at = [x["path"], x["start"], x["n"]]
            out.append(at)
    return [tuple(x) for x in out]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


MARK = pa.list_(pa.struct([("path", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("d", pa.binary())]))


def _cut(window: int, with_text: bool, columns: list[str]):
    """Drop covered words; digest columns, and the kept text if asked for (unchanged where nothing is covered); marks: each
    span with the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, batch.schema.get_field_index("text")):
                texts, spans = b.column("text").to_pylist(), b.column("spans").to_pylist()
                n_words, n_removed, digest, kept_text, marks = [], [], [], [], []
                for text, cover in zip(texts, spans, strict=True):
                    words = (text or "").encode().split()
                    keep, own = words, []
                    if cover:
                        edge = np.zeros(len(words) + 1, np.int64)
                        long = _joined(cover)
                        at = np.array([x[1:] for x in long])
                        np.add.at(edge, at[:, 0], 1)
                        np.add.at(edge, at[:, 0] + at[:, 1] + window - 1, -1)
                        free = np.cumsum(edge[:-1]) == 0
                        keep = [x for x, f in zip(words, free.tolist(), strict=True) if f]
                        own = [{"path": p, "start": s, "n": n, "d": _digest(words[s : s + n + window - 1])} for p, s, n in long]
                    joined = b" ".join(keep)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(keep))
                    marks.append(own)
                    if with_text:
                        kept_text.append(text if len(keep) == len(words) else joined.decode())
                    else:
                        digest.append(hashlib.sha256(joined).hexdigest())
                cols = {c: b.column(c) for c in columns}
                cols |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
                cols |= {"kept_text": pa.array(kept_text, pa.string())} if with_text else {"kept_sha256": pa.array(digest, pa.string())}
                cols["marks"] = pa.array(marks, MARK)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _digested_windows(window: int):
    """The windows of the listed spans of each row by their own words: (_k, _h, path, p, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, batch.schema.get_field_index("text")):
                rows = []
                for k, h, text, spans in zip(*(b.column(c).to_pylist() for c in ("_k", "_h", "text", "spans")), strict=True):
                    words = (text or "").encode().split()
                    rows += [(k, h, x["path"], p, _digest(words[p : p + window])) for x in spans for p in range(x["start"], x["start"] + x["n"])]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["_k", "_h", "path", "p", "d"])

    return run


def paths(classes: DataFrame) -> DataFrame:
    """classes (s, c, next): distinct segments, how often each occurs, the segment that always follows it or null.

    Returns a staged (s, path) of the segments that are not the first of their path; a path's number is its first segment.
    A segment and the next one belong to a path if the next one occurs no more often, so nothing else leads there.
    """
    after = classes.select(F.col("s").alias("to"), F.col("c").alias("_c"))
    steps = classes.filter("next is not null").join(after, (F.col("next") == F.col("to")) & (F.col("c") == F.col("_c")))
    up = staged(steps.select(F.col("to").alias("s"), F.col("s").alias("path")), "steps")
    while True:
        above = up.select(F.col("s").alias("_s"), F.col("path").alias("_up"))
        step = up.join(above, up.path == above._s, "left").select("s", F.coalesce("_up", "path").alias("path"), F.col("_up").isNotNull().alias("moved"))
        step = staged(step, "steps")
        dropped(up)
        up = step.select("s", "path")
        up._staged_path = step._staged_path
        if step.filter("moved").isEmpty():
            return up


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = 64) -> DataFrame:
    """(_k, _h, start, n, path, head): windows [start, start + n) of the row recur elsewhere, by hash; staged."""
    ready(docs.sparkSession)
    keyed = with_row_key(docs, "text")
    anchors = keyed.select("text").mapInArrow(_segment_batches(window, anchor, True, bits), "m long")
    repeated = staged(anchors.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m"), "anchors")
    segments = keyed.mapInArrow(_segment_batches(window, anchor, False, bits), "_k long, _h int, start int, n int, m long, s long, next long")
    segments = staged(segments.join(repeated, "m", "left_semi"), "segments")
    dropped(repeated)
    followed = F.when((F.min("next") == F.max("next")) & (F.count("next") == F.count("*")), F.min("next")).alias("next")
    distinct = staged(
        segments.groupBy("m", "s").agg(F.count("*").alias("c"), F.min(F.struct("_k", "_h", "start", "n")).alias("at"), followed),
        "distinct",
    )
    again = distinct.filter("c > 1")
    placed = paths(again.select("s", "c", "next"))
    named = again.select("m", "s").join(placed, "s", "left").select("m", "s", F.coalesce("path", "s").alias("path"), F.col("path").isNull().alias("head"))
    named = staged(named, "paths")
    dropped(placed)
    whole = segments.join(named, ["m", "s"]).select("_k", "_h", "start", "n", "path", "head")

    alone = distinct.filter("c = 1")
    # Both sides of the join are tables, so the rows of an anchor in a frequent line can be split.
    branching = distinct.join(staged(alone.select("m").distinct(), "branching"), "m", "left_semi")
    listed = branching.select("at._k", "at._h", F.struct("at.start", "at.n", "m", (F.col("c") == 1).alias("single")).alias("seg"))
    listed = listed.groupBy("_k", "_h").agg(F.collect_list("seg").alias("segs"))
    # Rows that repeat share a key; one of them stands for all, as a single segment has one row only.
    texts = keyed.join(listed.hint("shuffle_hash"), ["_k", "_h"]).select("_k", "_h", "text", "segs")
    windows = staged(texts.mapInArrow(_open_windows(window, bits), "_k long, _h int, p int, single boolean, m long, w long"), "windows")
    dropped(distinct)
    shared = windows.groupBy("m", "w").agg(F.count("*").alias("c")).filter("c > 1").select("m", "w")
    ends = windows.join(staged(shared, "edges"), ["m", "w"], "left_semi")
    part = ends.select("_k", "_h", F.col("p").alias("start"), F.lit(1).alias("n"), F.xxhash64("m", "w").alias("path"), F.lit(True).alias("head"))
    spans = staged(whole.unionByName(part), "spans")
    dropped(segments)
    dropped(windows)
    return spans


def _recurring(docs: DataFrame, marks: DataFrame, mixed: DataFrame, window: int) -> DataFrame:
    """Windows of the spans of ``mixed`` paths whose own words recur among the occurrences of the path."""
    doubted = marks.join(mixed, "path", "left_semi").distinct()
    listed = doubted.groupBy("_k", "_h").agg(F.collect_set(F.struct("path", "start", "n")).alias("spans"))
    texts = with_row_key(docs, "text").join(listed.hint("shuffle_hash"), ["_k", "_h"]).select("_k", "_h", "text", "spans")
    opened = staged(texts.mapInArrow(_digested_windows(window), "_k long, _h int, path long, p int, d binary"), "opened")
    again = staged(opened.groupBy("path", "d").agg(F.count("*").alias("c")).filter("c > 1").select("path", "d"), "recurring")
    found = opened.join(again, ["path", "d"], "left_semi").select("_k", "_h", F.col("p").alias("start")).distinct()
    return found.select("_k", "_h", "start", F.lit(1).alias("n"), F.xxhash64("_k", "_h", "start").alias("path"), F.lit(True).alias("head"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False, bits: int = 64) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with n_words, n_removed and kept_sha256, or with_text kept_text.

    Without ``with_text`` the other columns are left out.  Needs window > anchor.
    """
    ready(docs.sparkSession)
    carried = [c for c in docs.columns if c != "text"] if with_text else ["doc_id"]
    spans = repeated_spans(docs, window, anchor, bits)
    aside, names, types = with_columns_aside(docs, carried)
    rows = docs.select(*aside, "text", F.xxhash64("doc_id", "text").alias("_k"), F.hash("text", "doc_id").alias("_h"))
    last = "kept_text" if with_text else "kept_sha256"

    def cut(spans: DataFrame) -> DataFrame:
        # A set, as rows that repeat bring each of their spans again.
        listed = spans.groupBy("_k", "_h").agg(F.collect_set(F.struct("start", "n", "path", "head")).alias("spans"))
        joined = rows.join(listed.hint("shuffle_hash"), ["_k", "_h"], "left").select(*names, "_k", "_h", "text", "spans")
        schema = f"{types}, _k long, _h int, n_words long, n_removed long, {last} string, marks array<struct<path: long, start: int, n: int, d: binary>>"
        return joined.mapInArrow(_cut(window, with_text, [*names, "_k", "_h"]), schema)

    done = staged(cut(spans), "cut")
    marks = done.select("_k", "_h", F.explode("marks").alias("x")).select("_k", "_h", "x.path", "x.start", "x.n", "x.d")
    mixed = staged(marks.groupBy("path").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a <> b").select("path"), "mixed")
    if not mixed.isEmpty():
        right = _recurring(docs, marks.select("_k", "_h", "path", "start", "n"), mixed, window)
        done = cut(spans.join(mixed, "path", "left_anti").unionByName(right))
    return done.select(*names, "n_words", "n_removed", last).toDF(*carried, "n_words", "n_removed", last)

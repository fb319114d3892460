"""Near-duplicate detection: fast similarity sketching, banding, exact verification, connected components.

* A document's set holds the hashes of its distinct ``shingle``-word runs (a shorter document: its whole sequence).
* The sketch has t coordinates filled by rounds of hashed bin placement (Dahlgaard, Knudsen and Thorup, "Fast
  Similarity Sketching"): in round i < t each element drops into a random bin with value (i, hash); in round t + b every
  element drops into bin b, so each coordinate fills after 2t rounds at most; a bin keeps its least value.  The share of
  equal coordinates estimates the Jaccard similarity with Chernoff-type bounds.
* Documents of one set form a class; only classes go on.  Bands of ``rows`` coordinates give bucket keys.  At the
  default 48 x 8 a pair at similarity 0.85 shares no bucket with probability 2.3e-7.
* Beside its bands a class carries its set's size and the parities of its hashes over some bits for each element (an odd
  sketch).  Bits that differ between two classes are no more than the elements that do, so sizes and parities bound
  the similarity from above: a pair whose bound lies under the threshold cannot be linked and is left out.  That is exact;
  all other pairs are verified on their full sets.
* No bucket is expanded into all its pairs.  First each member of a bucket is held against a few leaders of it (those
  with the least random rank, in several orders); the best by their bounds are verified; links become components.  What is
  left are buckets that still hold several components: there members are compared across components, and only there, so no
  link between different components is lost.  Such a bucket is cut into blocks of about ``BLOCK_ROWS`` members; pairs of
  blocks are rows, pairs of documents are not, unless their bound reaches the threshold, and then only in the first
  bucket that they share.

Null and empty texts have the empty set and are linked with nothing; very long texts are read whole.  Repeated rows are one
class, and so are texts of equal sets (ties).  A null id takes no part in the choice of the smallest id.  An empty table
gives an empty result.  Other columns, whatever their names, are left out by ``near_dedup`` and kept as they are by
``keep_one``.  Set and class ids are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import NOT_SPACE, U, Words, arrow_text, dropped, mix, ready, runs, signed, slices, spans_hash, staged, windows_hash, with_columns_aside, with_row_key
from lexmill.llm.components import components, extended

SHINGLE, PERCENT, BANDS, ROWS = 5, 85, 48, 8
ORDERS, BEST, MAX_TURNS = 4, 3, 4
#: Members of a bucket that travel as one row when its sketches are compared block by block (about 50 kB).
BLOCK_ROWS = 64
#: Bits of an odd sketch: so many for each element of the set, as a power of two between these limits.
BITS_EACH, LEAST_BITS, MOST_BITS = 4, 64, 1 << 17
#: Words of 64 bits that are compared in one numpy step.
STEP_WORDS = 1 << 20
#: Pairs for each member of a bucket that the last pass takes without another turn of leaders.
PAIRS_EACH = 64
_BAND_BASE = 0x8BB84B93962EACC9 | 1


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the run."""
    full = mix(windows_hash(words.hash, k), 4)
    first = words.first
    for i in range(words.hi - words.lo):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            short = spans_hash(words.hash[a:b], np.array([0]), np.array([b - a]), _BAND_BASE)
            yield mix(short, 40 + b - a)
        else:
            yield np.empty(0, U)


def sketch(s: np.ndarray, t: int) -> np.ndarray:
    """t values (round << 32 | hash) of a set that is not empty."""
    out = np.full(t, np.iinfo(np.uint64).max, U)
    free, i = np.iinfo(np.uint64).max, 0
    with np.errstate(over="ignore"):
        while i < t:
            n_rounds = min(t - i, max(1, int(t * (np.log(t) + 2) / len(s) / (1 if i == 0 else 4)) + 1))
            rounds = np.arange(i, i + n_rounds, dtype=U)
            z = mix((s[None, :] ^ mix(rounds, 7)[:, None]).ravel(), 8)
            bins = ((z >> U(32)) * U(t)) >> U(32)
            value = np.repeat(rounds << U(32), len(s)) | (z & U(0xFFFFFFFF))
            np.minimum.at(out, bins.astype(np.int64), value)
            i += n_rounds
            if (out != free).all():
                return out
        for b in np.flatnonzero(out == free):
            z = mix(s ^ mix(np.array([t + b], U), 7), 8)
            out[b] = (U(t + int(b)) << U(32)) | (z & U(0xFFFFFFFF)).min()
    return out


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes over a power of two of bits, as 64-bit words."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * len(s) - 1).bit_length()))
    parity = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<u8")


def differing(a: list[np.ndarray], b: list[np.ndarray], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bits in which the odd sketches a[r] and b[c] differ, for every pair; the longer one is folded to the shorter."""
    out = np.zeros(len(r), np.int64)
    size_a, size_b = np.array([len(x) for x in a])[r], np.array([len(x) for x in b])[c]
    size = np.minimum(size_a, size_b)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        rows, of_row = np.unique(r[at], return_inverse=True)
        cols, of_col = np.unique(c[at], return_inverse=True)
        x, y = (np.stack([np.bitwise_xor.reduce(v[i].reshape(-1, n), axis=0) for i in ids.tolist()]) for v, ids in ((a, rows), (b, cols)))
        step = max(1, STEP_WORDS // n)
        for i in range(0, len(at), step):
            out[at[i : i + step]] = np.bitwise_count(x[of_row[i : i + step]] ^ y[of_col[i : i + step]]).sum(axis=1)
    return out


def most_alike(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of intersection (from above) and union (from below) of sets of these sizes that differ in so many elements."""
    differ = np.maximum(differ, np.abs(n_a - n_b))
    return n_a + n_b - differ, n_a + n_b + differ


def _sketches(k: int, bands: int, rows: int):
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(bands, dtype=U), 9)
        at = np.arange(0, t, rows)
        for batch in batches:
            for b in slices(batch, batch.schema.get_field_index("text")):
                data, off = arrow_text(b.column("text"))
                for w in runs(data, off, NOT_SPACE, lower=True):
                    n, fp, keys, odd = [], [], [], []
                    with np.errstate(over="ignore"):
                        for s in shingle_sets(w, k):
                            n.append(len(s))
                            fp.append(mix(s, 5).sum(dtype=U) + U(len(s)))
                            if len(s):
                                keys.append(mix(spans_hash(sketch(s, t), at, at + rows, _BAND_BASE) ^ salt, 10))
                                odd.append(odd_sketch(s).tobytes())
                            else:
                                keys.append(np.empty(0, U))
                                odd.append(b"")
                    bounds = np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32)
                    flat = np.concatenate(keys) if keys else np.empty(0, U)
                    cols = [b.column(c).slice(w.lo, w.hi - w.lo) for c in ("doc_id", "_k", "_h")]
                    cols += [pa.array(n, pa.int64()), pa.array(signed(np.array(fp, U)))]
                    cols += [pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(flat))), pa.array(odd, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "_k", "_h", "n_shingles", "cid", "bands", "odd"])

    return run


def _sketch_list(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def _possible(percent: int):
    """Pairs that the bounds leave possible: (a, b, est), est being the bound of their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            each = np.arange(b.num_rows)
            differ = differing(_sketch_list(b.column("oa")), _sketch_list(b.column("ob")), each, each)
            common, union = most_alike(b.column("na").to_numpy(), b.column("nb").to_numpy(), differ)
            ok = pa.array(100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(common / union).filter(ok)], names=["a", "b", "est"])

    return run


def _possible_in_blocks(percent: int):
    """Rows of two blocks of a bucket (key; m, o: lists of cid, comp, n, odd, bands; same) -> pairs (a, b), each once.

    A pair lies in two components and its bounds leave a link possible.  Every bucket that it shares holds both
    components, so all of them are compared; only the bucket of the least key returns the pair.
    """

    def members(lists: pa.Array, i: int):
        one = lists[i].values
        bands = one.field("bands").flatten().to_numpy().reshape(len(one), -1)
        return one.field("cid").to_numpy(), one.field("comp").to_numpy(), one.field("n").to_numpy(), _sketch_list(one.field("odd")), bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            m, o, same, key = batch.column("m"), batch.column("o"), batch.column("same").to_pylist(), batch.column("key").to_pylist()
            for i in range(batch.num_rows):
                (a, ca, na, x, ka), (b, cb, nb, y, kb) = members(m, i), members(o, i)
                small, large = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
                ok = (100 * small >= percent * large) & (ca[:, None] != cb[None, :])
                if same[i]:
                    ok &= a[:, None] < b[None, :]
                r, c = np.nonzero(ok)
                common, union = most_alike(na[r], nb[c], differing(x, y, r, c))
                ok = 100 * common >= percent * union
                r, c = r[ok], c[ok]
                first = ~((ka[r] == kb[c]) & (ka[r] < key[i])).any(axis=1)
                found_a.append(a[r[first]])
                found_b.append(b[c[first]])
            one, two = np.concatenate(found_a), np.concatenate(found_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    return run


def _verify(k: int, percent: int):
    """Pairs with 100 * |A and B| >= percent * |A or B| on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            both = []
            for c in ("xa", "xb"):
                data, off = arrow_text(b.column(c))
                both.append([s for w in runs(data, off, NOT_SPACE, lower=True) for s in shingle_sets(w, k)])
            for s, o in zip(*both, strict=True):
                common = len(np.intersect1d(s, o, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(o) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, _k, _h (row key), n_shingles, component_id, kept."""
    ready(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = with_row_key(docs, "doc_id", "text")
    schema = f"doc_id {id_type}, _k long, _h int, n_shingles long, cid long, bands array<long>, odd binary"
    sketches = staged(keyed.mapInArrow(_sketches(shingle, bands, rows), schema), "sketches")
    classes = staged(
        sketches.filter("n_shingles > 0").groupBy("cid").agg(
            F.min("doc_id").alias("least_id"), F.min(F.struct("_k", "_h")).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")
        ),
        "classes",
    )
    comp = _class_components(keyed, classes, shingle, percent)

    of_class = classes.select("cid", "least_id")
    if comp is not None:
        placed = of_class.join(comp, of_class.cid == comp.node, "left").select("cid", "least_id", F.coalesce("root", "cid").alias("root"))
        least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
        of_class = staged(placed.join(least, "root").select("cid", "component_id"), "placed")
    else:
        of_class = of_class.withColumnRenamed("least_id", "component_id")
    out = sketches.select("doc_id", "_k", "_h", "n_shingles", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_k", "_h", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _class_components(keyed: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """(node = cid, root) of the classes that have a link; None if there is no link at all."""
    exploded = classes.select("cid", F.explode("bands").alias("key"))
    crowded = staged(exploded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "buckets")
    members = staged(exploded.join(crowded, "key", "left_semi"), "members")
    if members.isEmpty():
        return None
    able = members.select("cid").distinct()
    able = staged(classes.join(able, "cid", "left_semi").select("cid", "at", "n", "odd", "bands"), "able")
    at = able.select("cid", "at._k", "at._h")
    # Rows that repeat share a key; their texts are equal and the pair of keys is the same, so one is enough.
    texts = keyed.select("_k", "_h", "text").join(at.hint("shuffle_hash"), ["_k", "_h"]).select("cid", "text")
    texts = staged(texts, "texts")
    sized = able.select("cid", "n", "odd")

    def nearest(pairs: DataFrame) -> DataFrame:
        """pairs (a, b), distinct -> staged pairs of each a with its BEST partners by their bounds."""
        pairs = staged(pairs, "pairs")
        both = pairs.join(sized.toDF("a", "na", "oa"), "a").join(sized.toDF("b", "nb", "ob"), "b")
        near = both.select("a", "b", "na", "oa", "nb", "ob").mapInArrow(_possible(percent), "a long, b long, est double")
        # At most ORDERS leaders for each bucket of a class: lists are short.
        listed = near.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("est", "b")), asc=False), 1, BEST).alias("best"))
        near = staged(listed.select("a", F.explode("best").alias("x")).select("a", "x.b"), "near")
        dropped(pairs)
        return near

    def across(own: DataFrame) -> DataFrame:
        """own (key, cid, comp, main, n_main, n_few) -> staged pairs of different components of a bucket that may be linked."""
        is_main = F.col("comp") == F.col("main")
        n_blocks = F.ceil(F.when(is_main, F.col("n_main")).otherwise(F.col("n_few")) / BLOCK_ROWS)
        member = F.struct("cid", "comp", "n", "odd", "bands").alias("member")
        dealt = own.join(able.select("cid", "n", "odd", "bands"), "cid").select("key", is_main.alias("is_main"), F.pmod(F.xxhash64(F.lit(-1), "cid"), n_blocks).alias("block"), member)
        blocks = staged(dealt.groupBy("key", "is_main", "block").agg(F.collect_list("member").alias("m")), "blocks")
        one = blocks.filter("not is_main").select("key", "block", "m")
        two = blocks.select("key", F.col("block").alias("other"), "is_main", F.col("m").alias("o"))
        both = one.join(two, "key").filter("is_main or block <= other").select("key", "m", "o", (~F.col("is_main") & (F.col("block") == F.col("other"))).alias("same"))
        near = staged(both.mapInArrow(_possible_in_blocks(percent), "a long, b long"), "near")
        dropped(blocks)
        return near

    def verified(near: DataFrame) -> DataFrame:
        """near (a, b), distinct and staged -> staged links."""
        one = texts.select(F.col("cid").alias("a"), F.col("text").alias("xa"))
        two = texts.select(F.col("cid").alias("b"), F.col("text").alias("xb"))
        full = near.join(one, "a").join(two, "b").select("a", "b", "xa", "xb")
        links = staged(full.mapInArrow(_verify(shingle, percent), "a long, b long"), "links")
        dropped(near)
        return links

    comp: DataFrame | None = None
    n_members, before = members.count(), 0
    for turn in range(MAX_TURNS):
        placed = members.select("key", "cid", F.col("cid").alias("comp"))
        if comp is not None:
            placed = members.join(comp, members.cid == comp.node, "left").select("key", "cid", F.coalesce("root", "cid").alias("comp"))
        counts = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
        mixed = counts.agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("c")).filter("c > 1")
        mixed = staged(mixed.select("key", F.col("top.comp").alias("main"), F.col("top.n").alias("n_main"), (F.col("all") - F.col("top.n")).alias("n_few")), "mixed")
        left = mixed.agg(F.sum(F.col("n_few") * (F.col("n_few") + F.col("n_main")))).first()[0]
        if left is None:
            break
        # Another turn of leaders while pairs across components are many and get fewer; the last turn takes them all in any case.
        last = turn > 0 and (left <= PAIRS_EACH * n_members or 2 * left > before or turn == MAX_TURNS - 1)
        before = left
        own = placed.join(mixed, "key")
        if last:
            near = across(own)
        else:
            rank = [F.min(F.struct(F.xxhash64(F.lit(turn * ORDERS + i), "cid").alias("r"), F.col("cid").alias("b"), F.col("comp").alias("bc"))).alias(f"l{i}") for i in range(ORDERS)]
            leaders = own.groupBy("key").agg(*rank).select("key", F.array_distinct(F.array(*[F.struct(f"l{i}.b", f"l{i}.bc") for i in range(ORDERS)])).alias("leaders"))
            pairs = placed.join(staged(leaders, "leaders"), "key").select(F.col("cid").alias("a"), "comp", F.explode("leaders").alias("l")).filter("l.bc <> comp")
            near = nearest(pairs.select("a", "l.b").distinct())
        found = verified(near)
        if not found.isEmpty():
            comp = components(found) if comp is None else extended(comp, found)
        if last:
            break
    return comp


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: those of the smallest id of each group, one of them if the row repeats."""
    kept = near_duplicates(docs, **options).filter("kept").groupBy("_k", "_h").agg(F.count("*").alias("_n"))
    kept = staged(kept, "kept")
    aside, names, _ = with_columns_aside(docs, docs.columns)
    rows = docs.select(*aside, F.xxhash64("doc_id", "text").alias("_k"), F.hash("text", "doc_id").alias("_h"))
    found = rows.join(kept.filter("_n = 1").select("_k", "_h").hint("shuffle_hash"), ["_k", "_h"], "left_semi").select(*names)
    again = kept.filter("_n > 1").select("_k", "_h")
    if not again.isEmpty():
        # Repeats are combined before they are shuffled, so a row however frequent meets in one place as one row a task.
        repeats = rows.join(again.hint("shuffle_hash"), ["_k", "_h"], "left_semi")
        single = repeats.groupBy("_k", "_h").agg(F.first(F.struct(*names)).alias("row"))
        found = found.unionByName(single.select("row.*"))
    return found.toDF(*docs.columns)

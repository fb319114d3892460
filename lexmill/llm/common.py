"""Shared parts: staged tables, row keys, and vectorised word hashing over Arrow string buffers."""

from __future__ import annotations

import atexit
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.shipping import ready as ready

#: Bytes of text that one vectorised step holds (a longer text is cut at a separator, so words stay whole).
BLOCK = 1 << 20


# -- staged tables


def shared_dir(spark) -> str:
    from lexmill.plans.lineage import checkpoint_dir

    return checkpoint_dir(spark)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared checkpoint folder and read it back.

    It cuts the lineage (a lost executor costs no recomputation of what lies before) and keeps only the columns a later
    step reads.  The driver's collector runs after it, so shuffle files of finished steps go from the executors' disks.
    Tables go when the driver ends, or earlier by :func:`dropped`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


_PATHS: list = []


def dropped(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    for item in [x for x in _PATHS if x[1] == path]:
        _PATHS.remove(item)
        _delete(*item)


def _delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for item in _PATHS:
        try:
            _delete(*item)
        except Exception:  # the JVM may be gone already; its folder then outlives this driver
            return


# -- columns


def fold(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty string)."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def with_row_key(docs: DataFrame, *keep: str) -> DataFrame:
    """keep + (_k long, _h int): a key made of id and text.  Rows of one id and one text share it, others do not."""
    return docs.select(*keep, F.xxhash64("doc_id", "text").alias("_k"), F.hash("text", "doc_id").alias("_h"))


def session_conf(spark, key: str, default: str) -> str:
    return spark.conf.get(key, default)


def with_columns_aside(docs: DataFrame, carry: list[str]) -> tuple[list[Column], list[str], str]:
    """Columns of docs under names of their own (_c0, _c1, ...), these names, and their schema: no column can clash."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [f"_c{i}" for i in range(len(carry))]
    return [F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], names, ", ".join(f"{n} {types[c]}" for c, n in zip(carry, names, strict=True))


def rows_where(docs: DataFrame, judge: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of docs whose text is kept, with their columns as they are.

    judge() is called once a task and gives a function from a batch's texts to a mask.  A row travels to Python and, if
    it stays, back once; whatever the other columns are named, they ride along by position.
    """
    at = docs.columns.index("text")
    base = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = judge()
        for batch in batches:
            yield from (b.filter(pa.array(mask(b.column(at)), pa.bool_())) for b in slices(batch, at))

    return base.mapInArrow(run, base.schema).toDF(*docs.columns)


def slices(batch: pa.RecordBatch, at: int, limit: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text (column ``at``), one row at least."""
    _, off = arrow_text(batch.column(at))
    for lo, hi in groups_of(off, limit):
        yield batch.slice(lo, hi - lo)


# -- bytes and words


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: Words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = ~byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_R, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        z = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, i < n; those of a block of words are kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                a = np.full(size, b, dtype=U)
                a[0] = 1
                both.append(np.multiply.accumulate(a))
        have = (both[0], both[1])
        if size <= BLOCK:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span, from one running sum modulo 2**64.

    For values that are hashes themselves and spans of some dozen values only: of plain bytes, long spans can be made
    to collide under any base.
    """
    with np.errstate(over="ignore"):
        pw, inv = powers(base, len(values) + 1)
        run = np.empty(len(values) + 1, U)
        run[0] = 0
        np.cumsum(values * pw[: len(values)], out=run[1:])
        return (run[end] - run[start]) * inv[start]


#: Bytes of a span up to which it is hashed in numpy, eight bytes a step; longer ones go through BLAKE2b.
SHORT_SPAN = 64


def piece_hash(x: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each byte span: its length, then eight bytes at a time through two rounds of mixing each."""
    size = end - start
    out = mix(size.astype(U) ^ U(salt), 5)
    if not len(out):
        return out
    padded = np.append(x, np.zeros(8, np.uint8))
    eight = np.ndarray((len(x) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= SHORT_SPAN))
    at, left, h = start[live], size[live], out[live]
    while len(live):
        chunk = eight[at]
        rest = np.minimum(left, 8).astype(U)
        chunk &= U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * rest)
        with np.errstate(over="ignore"):
            h = mix(mix(chunk + h * U(_R), 6) ^ (h >> U(32)), 7)
        out[live] = h
        more = left > 8
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > SHORT_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(x[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def windows_hash(words: np.ndarray, k: int, base: int = _Q) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    at = np.arange(n)
    return spans_hash(words, at, at + k, base)


def arrow_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), off


def groups_of(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts [lo, hi) of about ``limit`` bytes, one text at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of a run of texts: 64-bit hashes, byte spans (in the column's buffer) and text numbers, in order."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int, table: np.ndarray, lower: bool):
        a, b = int(off[lo]), int(off[hi])
        firsts = off[lo:hi][np.diff(off[lo : hi + 1]) > 0]
        hashes, starts, ends = [], [], []
        while a < b:
            cut = b
            if b - a > 2 * BLOCK:  # a very long text: cut before the first separator after a block
                cut = a + BLOCK
                while cut < b:
                    gap = np.flatnonzero(~table[LOWER[data[cut : cut + BLOCK]] if lower else data[cut : cut + BLOCK]])
                    if len(gap):
                        cut += int(gap[0])
                        break
                    cut = min(b, cut + BLOCK)
            x = data[a:cut]
            x = LOWER[x] if lower else x
            inside = np.zeros(len(x) + 2, bool)
            inside[1:-1] = table[x]
            fresh = np.zeros(len(x) + 1, bool)  # a text begins here
            fresh[firsts[(firsts >= a) & (firsts < cut)] - a] = True
            s = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
            e = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
            hashes.append(piece_hash(x, s, e))
            starts.append(s + a)
            ends.append(e + a)
            a = cut
        none = np.empty(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, U)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.doc = np.searchsorted(off[lo : hi + 1], self.start, side="right") - 1
        self.lo, self.hi = lo, hi
        #: Words of text i of the run are [first[i], first[i + 1]).
        self.first = np.searchsorted(self.doc, np.arange(hi - lo + 1))

    def __len__(self) -> int:
        return len(self.hash)


def runs(data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = False, limit: int = BLOCK) -> Iterator[Words]:
    for lo, hi in groups_of(off, limit):
        yield Words(data, off, lo, hi, table, lower)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        size += step
    return at

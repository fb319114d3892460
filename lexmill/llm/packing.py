"""Packing token sequences by best-fit decreasing.

A document's ids are cut into full windows first; a full window is a sequence of its own.  The remainders (one for each
document at most) are packed longest first, each into the open sequence with the least room that still takes it.  A segment
tree over room 0..window finds that sequence in a step per level.  Remainders are dealt evenly into groups of about
``group_docs`` rows, and a group is packed by one task: its size is fixed, so only the number of groups grows with the
input, and each group leaves a few unfilled sequences at most.  Only lengths and checksums are shuffled, never texts or
ids, unless ``with_ids`` asks for the ids themselves.

Null text is empty: its document is the closing id alone.  Very long texts are cut into windows as they are encoded, whole.
Repeated rows are documents of their own, dealt by their place in the input, so however often a row repeats no group
grows.  Remainders of one length are placed in an order by checksum, so ties are settled alike in every run over the same
files.  A null id is carried like any other.  Columns other than doc_id and text are not read, whatever their names.  An
empty table gives no piece.
"""

from __future__ import annotations

import secrets
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import U, arrow_text, groups_of, mix, piece_hash, ready, signed, slices, staged

WINDOW, CLOSING, GROUP_DOCS = 4096, 2, 20_000
SLOTS, POOL_IDS = np.uint64((1 << 21) - 1), 1 << 22

#: Characters that a text may not hold for the block-wise cutting: all but ASCII and the letters U+00C0 to U+017F,
#: without the two signs among them and letters whose lower case is not one letter; and the head of a special token.
ODD = r"[^\x00-\x7FÀ-ÖØ-öø-įĲ-ňŊ-ž]|<\|"
#: 0 white space, 1 letter (any byte of an accented one too), 2 digit, 3 other.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2
SHORT = np.frombuffer(b"stmd", np.uint8)


class Encoder:
    """Token ids of a column of texts, as the tokenizer gives them without special tokens, plus the closing id.

    The tokenizer lower-cases, cuts a text into runs of letters, single digits and runs of other signs, and merges inside
    each of these only.  For texts of ASCII and accented Latin letters the cutting is done here for a whole block at
    once, each distinct piece goes through the tokenizer's own model once, and a bounded table remembers pieces by a
    64-bit hash under a secret salt, so no input can be made to collide in it.  The table lives as long as a task.  Texts with any other character, or with what may be a special token, are encoded whole.
    """

    def __init__(self, path: str, closing: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.closing = Tokenizer.from_file(path), closing
        self.model, self.salt = self.tokenizer.model, secrets.randbits(64)
        self.clear()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        #: The byte-level alphabet: printable bytes stand for themselves, others for signs from U+0100 on.
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def clear(self) -> None:
        """An empty table of one slot for each hash prefix: the piece's hash, and where its ids lie in the pool."""
        self.key = np.zeros(int(SLOTS) + 1, np.uint64)
        self.begin, self.size = np.zeros(len(self.key), np.int32), np.zeros(len(self.key), np.int32)
        self.pool, self.used = np.zeros(POOL_IDS // 4, "<u4"), 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, raw: bytes) -> bytes:
        text = raw.decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(text if text.isalpha() and text.isascii() else text.translate(self.alphabet))]).tobytes()

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every row, in order."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        data, off = arrow_text(pc.utf8_lower(plain))
        for lo, hi in groups_of(off):
            ids, first = self._block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for i in range(lo, hi):
                if odd[i]:
                    own = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
                else:
                    own = ids[first[i - lo] : first[i - lo + 1]]
                yield i, np.append(own, np.uint32(self.closing)).astype("<u4")

    def _block(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of lower-cased plain texts, and where each text's ids begin."""
        n = len(x)
        kind = KIND[x]
        start = np.zeros(n + 4, bool)
        start[:n] = kind != 0
        same = np.zeros(n, bool)
        same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != 2)
        heads = off[:-1][np.diff(off) > 0]
        same[heads] = False
        start[:n] &= ~same
        tail = np.append(x, np.zeros(4, np.uint8))
        quote = np.flatnonzero(start[:n] & (x == 39))
        if len(quote):
            stop = off[np.searchsorted(off, quote, side="right")]
            one, two = tail[quote + 1], tail[quote + 2]
            short = np.isin(one, SHORT) & (quote + 1 < stop)
            long = ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)) & (quote + 2 < stop)
            for found, size in ((short, 2), (long & ~short, 3)):
                at = quote[found]
                start[at + 1] = False
                then = at + size
                inside = (then < stop[found]) & (np.append(kind, np.zeros(4, kind.dtype))[then] == 1)
                start[then[inside]] = True
        start = start[:n]
        # Every text begins with a piece or with white space, so the next edge ends a piece inside its text.
        edge = np.append(np.flatnonzero(start | (kind == 0)), n)
        own = np.flatnonzero(start[edge[:-1]])
        s, e = edge[own], edge[own + 1]
        hashed = piece_hash(x, s, e, self.salt)
        slot = (hashed & SLOTS).astype(np.int64)
        if self.used > POOL_IDS:
            self.used = 0
            self.key[:] = 0
        begin, each = self.begin[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missed = np.flatnonzero(self.key[slot] != hashed)
        if len(missed):
            fresh, at, back = np.unique(hashed[missed], return_index=True, return_inverse=True)
            new = [self._piece(x[s[i] : e[i]].tobytes()) for i in missed[at].tolist()]
            size = np.array([len(v) // 4 for v in new], np.int64)
            ids = np.frombuffer(b"".join(new), "<u4")
            offset = self.used + np.cumsum(size) - size
            self.used += len(ids)
            if self.used > len(self.pool):
                self.pool = np.append(self.pool, np.zeros(max(len(ids), len(self.pool)), "<u4"))
            self.pool[self.used - len(ids) : self.used] = ids
            to = (fresh & SLOTS).astype(np.int64)
            self.key[to], self.begin[to], self.size[to] = fresh, offset, size
            begin[missed], each[missed] = offset[back], size[back]
        end = np.cumsum(each)
        total = int(end[-1]) if len(end) else 0
        ids = self.pool[np.repeat(begin - (end - each), each) + np.arange(total)]
        return ids, np.append(0, end)[np.searchsorted(s, off)]


def encoder(path: str, closing: int) -> Encoder:
    """One for each worker process, as loading a vocabulary takes long; tasks clear its table."""
    if (path, closing) not in _ENCODERS:
        _ENCODERS[path, closing] = Encoder(path, closing)
    return _ENCODERS[path, closing]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _pieces(path: str, window: int, closing: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part_id, done, encode = task.partitionId() if task else 0, 0, encoder(path, closing)
        for batch in batches:
            for b in slices(batch, 1):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, own in encode.column(b.column("text")):
                    n, raw = len(own), own.tobytes()
                    for s in range(0, n, window):
                        part = raw[4 * s : 4 * (s + window)]
                        row.append(i)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        if with_ids:
                            ids.append(part)
                lot = signed(mix(np.arange(done, done + len(row), dtype=U) + (U(part_id) << U(40)), 3))
                done += len(row)
                cols = [b.column("doc_id").take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total, lot)]
                cols += [pa.array(ids, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"] + ["ids"] * with_ids)
        encode.clear()

    return run


class RoomTree:
    """Counts of open sequences by room; ``fit`` finds the least room of at least a length."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def fit(self, length: int) -> int:
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths, window: int) -> tuple[list[int], list[int]]:
    """lengths, longest first -> (sequence, offset) of each."""
    tree, open_at = RoomTree(window), [[] for _ in range(window + 1)]
    sequence, offset, made = [], [], 0
    for n in lengths:
        room = tree.fit(n)
        if room < 0:
            s, room = made, window
            made += 1
        else:
            s = open_at[room].pop()
            tree.add(room, -1)
        sequence.append(s)
        offset.append(window - room)
        if room > n:
            open_at[room - n].append(s)
            tree.add(room - n, 1)
    return sequence, offset


def _pack_group(window: int):
    order = [("length", "descending"), *((c, "ascending") for c in ("ids_crc32", "doc_tokens", "start", "doc_id"))]

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.drop_columns(["lot"])
        group = group.take(pc.sort_indices(group, sort_keys=order))
        sequence, offset = best_fit(group["length"].to_pylist(), window)
        group = group.append_column("sequence_id", pa.array(np.array(sequence, np.int64) + (key[0].as_py() << 36)))
        return group.append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, closing: int = CLOSING, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, packed) for every piece."""
    ready(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    more = ", ids binary" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, window, closing, with_ids), f"{schema}, lot long{more}")
    pieces = staged(pieces, "pieces")
    columns = [c for c in pieces.columns if c != "lot"]
    # A full window fills a sequence; these ids are negative, those of packed sequences are not.
    full = pieces.filter(F.col("length") == window).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < window)
    groups = max(1, -(-rest.count() // group_docs))
    packed = rest.groupBy(F.pmod("lot", F.lit(groups)).alias("g")).applyInArrow(_pack_group(window), f"{schema}{more}, sequence_id long, offset long")
    return packed.unionByName(full)

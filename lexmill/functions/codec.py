"""Integer-list codecs as Column expressions: 4-byte big-endian, and delta with 7-bit groups (high bit: more follow)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


def naive_encode(values: Column) -> Column:
    """array<int> -> binary, four bytes each, big-endian."""
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF).cast("long")), 8, "0")), ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where body uses it in a lambda for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _slice(data: Column, start, length) -> Column:
    if start is None:
        return data
    return F.substring(data, F.lit(start + 1), F.lit(length))


def naive_decode(data: Column, start: int | None = None, length: int | None = None) -> Column:
    data = _slice(data, start, length)
    at = F.sequence(F.lit(1), F.length(data) - 3, F.lit(4))
    word = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(4))), 16, 10).cast("long").cast("int")
    return F.when(F.length(data) >= 4, F.transform(at, word)).otherwise(F.array().cast("array<int>"))


def varlen_hex(gap: Column) -> Column:
    """Hex of one non-negative int in big-endian 7-bit groups; zero or less gives 00."""
    gap = gap.cast("long")
    out = F.lpad(F.hex(gap.bitwiseAND(0x7F)), 2, "0")
    for k in range(1, 5):
        group = F.shiftright(gap, 7 * k).bitwiseAND(0x7F).bitwiseOR(0x80)
        out = F.concat(F.when(gap >= (1 << 7 * k), F.hex(group)).otherwise(F.lit("")), out)
    return F.when(gap <= 0, F.lit("00")).otherwise(out)


def gaps(values: Column) -> Column:
    return F.transform(values, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.element_at(values, i)))


def delta_encode_hex(values: Column) -> Column:
    return F.array_join(F.transform(let(values, gaps), varlen_hex), "")


def delta_encode(values: Column) -> Column:
    """Sorted array<int> -> binary of variable-length gaps (the first against 0)."""
    return F.unhex(delta_encode_hex(values))


#: Values of a run in which delta_decode sums up by doubling; sums of RUN ** LEVELS values are summed one by one.
RUN = 32
LEVELS = 3
#: The bytes of one value: those with the high bit, and the one without that ends it.
GROUP = r"[\x80-\xFF]*[\x00-\x7F]"


def _summed(values: Column) -> Column:
    """Running sums of array<long> inside each run of RUN values."""

    def doubled(k: int) -> Callable[[Column], Column]:
        return lambda a: F.transform(a, lambda v, i: F.when(i.bitwiseAND(RUN - 1) >= k, v + F.get(a, i - k)).otherwise(v))

    for p in range(RUN.bit_length() - 1):
        values = let(values, doubled(1 << p))
    return values


def _one_by_one(values: Column) -> Column:
    """Running sums of a short array<long>."""
    sums = F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    return F.slice(sums, F.lit(2), F.size(values))


def _running(values: Column, levels: int = LEVELS) -> Column:
    """Running sums of array<long>: runs are moved by the sums of those before, which are summed up likewise.

    A list of n costs n steps for each doubling in a run, and a RUN-th of that for each further level.
    """
    if not levels:
        return let(values, _one_by_one)

    def moved(a: Column) -> Column:
        ends = F.sequence(F.lit(RUN - 1), F.size(a) - 1, F.lit(RUN))
        before = _running(F.transform(ends, lambda at: F.get(a, at)), levels - 1)
        last = lambda sums, i: F.get(sums, F.shiftright(i, RUN.bit_length() - 1) - 1)
        return let(before, lambda sums: F.transform(a, lambda v, i: F.when(i < RUN, v).otherwise(v + last(sums, i))))

    summed = lambda v: let(_summed(v), lambda a: F.when(F.size(a) > RUN, moved(a)).otherwise(a))
    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(summed(v)))


def delta_decode(data: Column, start: int | None = None, length: int | None = None) -> Column:
    """The inverse: a value's bytes end at the first without its high bit; their gaps are then summed up.

    Bytes are read as characters of Latin-1, which parts them into values at once.
    """

    def gap(group: Column) -> Column:
        # Values of one or two bytes are most of them.
        two = (F.ascii(group) - 0x80) * 0x80 + F.ascii(F.substring(group, 2, 1))
        more = F.aggregate(F.split(group, ""), F.lit(0).cast("long"), lambda acc, c: F.shiftleft(acc, 7).bitwiseOR(F.ascii(c).bitwiseAND(0x7F).cast("long")))
        return F.when(F.length(group) == 1, F.ascii(group).cast("long")).when(F.length(group) == 2, two.cast("long")).otherwise(more)

    text = F.coalesce(F.decode(_slice(data, start, length), "ISO-8859-1"), F.lit(""))
    groups = F.regexp_extract_all(text, F.lit(GROUP), F.lit(0))
    return _running(F.transform(groups, gap)).cast("array<int>")


class Compressor(Protocol):
    """What an index can be given to store its lists of positions with."""

    def encode(self, values: Column) -> Column: ...

    def decode(self, data: Column) -> Column: ...


class NaiveCompressor:
    """Four bytes each."""

    encode, decode = staticmethod(naive_encode), staticmethod(naive_decode)


class DeltaCompressor:
    """Gaps of variable length."""

    encode, decode = staticmethod(delta_encode), staticmethod(delta_decode)

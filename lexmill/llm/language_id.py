"""Language identification by error-correcting output codes over byte trigrams.

Every learned language gets a codeword of bits.  For each bit a binary n-gram classifier weighs hashed byte trigrams of
words by the smoothed log odds of "languages with this bit" against the others.  A text's margins, one for each bit,
are decoded by loss: the codeword with the least exponential loss, bits weighted by how well they part the training
languages, wins; a text whose best two codewords lie close together is flagged as ambiguous.

Codes: for up to 5 languages all 2**(k-1) - 1 splits, beyond that as many random splits as keep codewords far apart.
Every language seen in the learning rows is learned, from about ``sample`` texts of each (by hash of the id); what comes
to the driver and to the tasks grows with the languages, not with the documents.

A null text or one without any letter, as an empty one, is ``und`` with score 0.  Without anything to learn from, as in an
empty table, every text is ``und``.  Very long texts are read whole, in blocks.  Rows that repeat are judged alike, each.
Of languages of equal loss the first by name wins.  Other columns are carried under any name, or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BLOCK, LOWER, arrow_text, fold, groups_of, ready

SAMPLE, FOLDS, HELD_OUT = 1500, 4, 2
#: Terms of losses that decoding holds at a time.
CELLS = 1 << 20
BUCKETS, SMOOTH, AMBIGUOUS = 1 << 16, 0.5, 0.2
#: Letters keep their byte (lower-cased), bytes of other signs become a blank.
CLASS = LOWER.copy()
CLASS[:65] = 32
CLASS[91:97] = 32
CLASS[123:128] = 32


def codewords(k: int, seed: int = 1) -> np.ndarray:
    """k distinct rows of -1 and 1."""
    if k == 1:
        return np.ones((1, 1), np.int8)
    if k <= 5:
        bits = np.array([[1] * (2 ** (k - 1) - 1)] + [[-1 if (c >> (k - 1 - r)) & 1 else 1 for c in range(1, 2 ** (k - 1))] for r in range(1, k)])
        return bits.astype(np.int8)
    rng, best, distance = np.random.default_rng(seed), None, 0
    tries = 0
    while best is None or tries < 200:
        tries += 1
        code = rng.choice(np.array([-1, 1], np.int8), (k, 8 * int(np.ceil(np.log2(k)))))
        wide = code.astype(np.int32)
        apart = int(((code.shape[1] - wide @ wide.T) // 2 + np.eye(k, dtype=np.int32) * code.shape[1]).min())
        if apart > distance and (abs(code.sum(0)) < k).all():
            best, distance = code, apart
    return best


def trigrams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram at each byte but the last two, and whether it counts (it has a letter in the middle)."""
    c = CLASS[x].astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16), c[1:-1] != 32


def _padded(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The run's bytes with a blank around each text, and text bounds in it."""
    a, b = off[lo], off[hi]
    bounds = off[lo : hi + 1] - a
    return np.insert(data[a:b], bounds, 32), bounds + np.arange(hi - lo + 1)


def _blocks(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of the run's trigrams and text bounds in them, so that a very long text comes in several blocks."""
    x, bounds = _padded(data, off, lo, hi)
    for a in range(0, len(x) - 2, 2 * BLOCK):
        part = x[a : a + 2 * BLOCK + 2]
        yield part, np.clip(bounds - a, 0, len(part))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) with n summed over the batch; each text counts by its shares, so long ones do not rule."""
    for b in batches:
        data, off = arrow_text(b.column("text"))
        langs = b.column("lang").to_pylist()
        names = sorted(set(langs))
        total = np.zeros((len(names), BUCKETS))
        for i, name in enumerate(langs):
            own = np.zeros(BUCKETS)
            for x, _ in _blocks(data, off, i, i + 1):
                h, ok = trigrams(x)
                own += np.bincount(h[ok], minlength=BUCKETS)
            total[names.index(name)] += own / np.sqrt(max(1.0, own.sum()))
        r, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in r], pa.string()), pa.array(c.astype(np.int32)), pa.array(total[r, c])], names=["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        shares = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
        weights = []
        for bit in self.code.T:
            one, other = shares[bit > 0].mean(0), shares[bit < 0].mean(0) if (bit < 0).any() else np.ones(BUCKETS) / BUCKETS
            weights.append(np.clip(np.log(one / other), -4, 4))
        self.weights = np.array(weights, np.float32).T.copy()
        # How well a bit parts the languages: the least margin a language's own trigrams reach on it.
        reach = (shares @ self.weights) * self.code
        self.trust = np.clip(reach.min(0), 0.05, None)
        self.trust /= self.trust.sum()

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each row of margins (mean log odds of a trigram)."""
        step = max(1, CELLS // self.code.size)
        parts = [(np.exp(-np.clip(4 * margins[i : i + step, None, :] * self.code[None], -30, 30)) * self.trust).sum(2) for i in range(0, len(margins), step)]
        losses = np.concatenate(parts) if parts else np.empty((0, len(self.langs)))
        likely = -np.log(losses + 1e-12)
        p = np.exp(likely - likely.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        second = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        top = p[np.arange(len(p)), best]
        return best, top, top - second < AMBIGUOUS


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for b in batches:
            texts = b.column("text")
            data, off = arrow_text(texts)
            lang = np.full(b.num_rows, "und", object)
            score, doubtful = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for lo, hi in groups_of(off) if model else ():
                total = np.zeros((hi - lo, model.weights.shape[1]))
                n, letters = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for x, bounds in _blocks(data, off, lo, hi):
                    h, ok = trigrams(x)
                    at = np.flatnonzero(ok)
                    heads = np.searchsorted(at, bounds)
                    here = np.diff(heads)
                    full = np.flatnonzero(here > 0)
                    if len(full):
                        total[full] += np.add.reduceat(model.weights[h[at]], heads[full], axis=0, dtype=np.float32)
                    n += here
                    ascii_letter = ((x | 32) >= 97) & ((x | 32) <= 122)
                    letters += np.diff(np.append(0, np.cumsum(ascii_letter))[bounds])
                best, p, close = model.decode(total / np.maximum(n, 1)[:, None])
                for i in np.flatnonzero(n > 0):
                    if letters[i] > 0 or _has_letter(texts[int(lo + i)].as_py() or ""):
                        lang[lo + i], score[lo + i], doubtful[lo + i] = model.langs[best[i]], p[i], close[i]
            cols = [b.column(c) for c in columns] + [pa.array(lang, pa.string()), pa.array(score), pa.array(doubtful)]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "lang_pred", "score", "ambiguous"])

    return run


def learn(docs: DataFrame, rows: Column, sample: int = SAMPLE) -> Model | None:
    """Fit from text and lang of the given rows of docs."""
    spark = ready(docs.sparkSession)
    known = docs.filter(rows).filter("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return None
    share = spark.createDataFrame([(r.lang, min(1.0, sample / r.n)) for r in sizes], "lang string, share double")
    lot = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    drawn = known.select("doc_id", "text", "lang").join(F.broadcast(share), "lang").filter(lot).select("text", "lang")
    counted = drawn.mapInArrow(_counts, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A fixed number of buckets for each language, as columns.
    table = counted.toArrow()
    names, buckets, n = table["lang"].to_pandas(), table["bucket"].to_numpy(), table["n"].to_numpy()
    langs = sorted(names.unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(langs, names), buckets] = n
    return Model(langs, counts) if langs else None


def identify(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id by default), lang_pred, score, ambiguous for every row."""
    spark = ready(docs.sparkSession)
    carry = ["doc_id"] if carry is None else carry
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [f"_c{i}" for i in range(len(carry))]
    base = docs.select("text", *[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)])
    schema = ", ".join([f"{n} {types[c]}" for n, c in zip(names, carry, strict=True)] + ["lang_pred string", "score double", "ambiguous boolean"])
    out = base.mapInArrow(_predict(spark.sparkContext.broadcast(model), names), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "lang_pred", "score", "ambiguous")


def held_out_languages(docs: DataFrame, **options) -> DataFrame:
    model = learn(docs, fold("doc_id", FOLDS) != HELD_OUT, **options)
    found = identify(docs, model)
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")

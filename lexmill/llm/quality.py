"""Quality rules with risk-controlled thresholds.

Base rule: too few words, or too many words in repeated windows.  Beyond it each rule rejects a document whose value
exceeds a cutoff.  Cutoffs come from labelled holdouts, for each stratum (language) apart.  One half of the labelled rows
(by a hash of the id) designs a sequence of rule sets, each stricter than the one before: of all rules the cutoff
that gains most, bad documents rejected at ``price`` good ones each, is tightened next.  The other half tests the sets in
this order: a set is certified while the exact (Clopper-Pearson) upper bound of its share of rejected good documents
stays within ``alpha`` at confidence 1 - ``delta`` / strata.  A set is tested as a whole, so rules need no share of alpha
each; testing in an order that the testing half did not choose, up to the first failure, needs no further correction
(fixed-sequence testing); the division by strata is Bonferroni's.  So with probability 1 - delta no stratum loses more
than alpha of its good documents.  The last certified set holds; a stratum with too few labels (146 good ones in the testing
half for four strata) has none.  Counts cover every labelled document that passes the base rule.

A null or empty text has no words and fails the base rule; very long texts are read whole.  Rows that repeat are judged alike,
each; in the counts an id counts once (of several texts the least by language and values, of several labels the
least), so repeats do not feign evidence.  Null languages are the stratum ``none``.  A value equal to its cutoff is not
rejected.  Empty tables, of documents or labels, give no cutoffs.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import NOT_SPACE, U, arrow_text, byte_table, fold, mix, ready, runs, slices, staged, windows_hash

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
ALPHA, DELTA, PRICE = 0.03, 0.05, 3
#: Strata whose cutoffs are broadcast; of more a table is joined.
BROADCAST_STRATA = 10_000
#: Rule -> cutoffs from lax to strict; a document is rejected by value > cutoff.
GRID = {
    "symbols_per_word": [x / 20 for x in range(40, 0, -1)],
    "dup_line_share": [x / 40 for x in range(40, 0, -1)],
    "repeat_share": [x / 100 for x in range(30, 0, -1)],
    "upper_share": [x / 40 for x in range(40, 1, -1)],
    "mean_chars": [x / 4 for x in range(80, 24, -1)],
    "short_words": [-x / 4 for x in range(0, 20)],
}
RULES = list(GRID)
_SYMBOL = byte_table()
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = ~byte_table((0x80, 0xBF))
_UPPER, _ALPHA = byte_table((65, 90)), byte_table((65, 90), (97, 122))
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(mask))[bounds])


def _duplicate_lines(text: str) -> tuple[int, int]:
    seen, n, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            n += 1
            dup += line in seen
            seen.add(line)
    return dup, n


def _measure(columns: list[str], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for batch in batches for b in slices(batch, batch.schema.get_field_index("text"))):
            texts = b.column("text")
            data, off = arrow_text(texts)
            parts: list[list[np.ndarray]] = []
            for w in runs(data, off, NOT_SPACE):
                n = np.diff(w.first)
                x, bounds = data[off[w.lo] : off[w.hi]], off[w.lo : w.hi + 1] - off[w.lo]
                chars = _per_text(_HEAD[x] & NOT_SPACE[x], bounds)
                repeated = np.zeros(len(w) + 1, np.int64)
                grams = windows_hash(w.hash, window)
                if len(grams):
                    at = np.flatnonzero(w.doc[: len(grams)] == w.doc[window - 1 :])
                    _, inverse, counts = np.unique(mix(grams[at] ^ mix(w.doc[at].astype(U), 11), 12), return_inverse=True, return_counts=True)
                    twice = at[counts[inverse] > 1]
                    np.add.at(repeated, twice, 1)
                    np.add.at(repeated, twice + window, -1)
                covered = np.cumsum(repeated)[:-1] > 0
                lines = [_duplicate_lines(texts[i].as_py() or "") for i in range(w.lo, w.hi)]
                dup, all_lines = np.array([d for d, _ in lines]), np.array([m for _, m in lines])
                n_repeat, symbols = _per_text(covered, w.first), _per_text(_SYMBOL[x], bounds)
                least = np.maximum(n, 1)
                rules = [symbols / least, dup / np.maximum(all_lines, 1), n_repeat / least, _per_text(_UPPER[x], bounds) / np.maximum(_per_text(_ALPHA[x], bounds), 1), chars / least, -chars / least]
                parts.append([n, chars, symbols, dup, n_repeat, *rules])
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0)] * (5 + len(RULES))
            arrays = [b.column(c) for c in columns] + [pa.array(c.astype(np.int64)) for c in cols[:5]] + [pa.array(c.astype(float)) for c in cols[5:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES])

    return run


def measure(docs: DataFrame, window: int = REPEAT_WINDOW) -> DataFrame:
    """doc_id, lang, the five base counts, a value for each rule and base_failed."""
    ready(docs.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {types['doc_id']}, lang string, {BASE}, " + ", ".join(f"{r} double" for r in RULES)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("none")) if "lang" in types else F.lit("none")
    out = docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(_measure(["doc_id", "lang"], window), schema)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the p at which k or fewer of n have probability delta."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs)) if 0 < p < 1 else float(p == 0)
        lo, hi = (p, hi) if tail > delta else (lo, p)
    return hi


def design(counts: dict[tuple[str, int], tuple[int, int]], price: float) -> list[dict[str, int]]:
    """Rule sets (rule -> level of its grid), each stricter than the one before.

    counts[(rule, level)] = good, bad documents whose value exceeds just the levels from that one on.
    """
    at, out = {r: -1 for r in RULES}, []
    while True:
        best = None
        for rule, grid in GRID.items():
            good = bad = 0
            for level in range(at[rule] + 1, len(grid)):
                g, b = counts.get((rule, level), (0, 0))
                good, bad = good + g, bad + b
                gain = bad - price * good
                if gain > 0 and (g or b):
                    rank = (good / bad, -gain, rule, level)
                    best = min(best, rank) if best else rank
        if best is None:
            return out
        at = at | {best[2]: best[3]}
        out.append({r: level for r, level in at.items() if level >= 0})


def certified(sets: int, rejected: dict[int, int], n: int, alpha: float, delta: float) -> int:
    """How many of the sets hold: rejected[i] good documents of n are rejected by set i first."""
    good = 0
    for i in range(sets):
        good += rejected.get(i, 0)
        # Far beyond the bound an exact tail need not be summed.
        if n == 0 or good > alpha * n or upper_bound(good, n, delta) > alpha:
            return i
    return sets


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE) -> dict[str, dict[str, float]]:
    """Cutoffs: stratum -> rule -> value.  At most strata * rules * grid counts come to the driver."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # The first level of the grid that the value exceeds; later (stricter) ones are exceeded too.
    levels = [F.expr(" + ".join(f"int({r} <= {c}D)" for c in g)).alias(r) for r, g in GRID.items()]
    held = measured.filter("not base_failed").join(marks, "doc_id").select("doc_id", "lang", "quality", *levels)
    held = held.groupBy("doc_id").agg(F.min(F.struct("lang", *RULES, "quality")).alias("x")).select("x.*", (fold("doc_id", 2) == 0).alias("designs"))
    held = staged(held, "labelled")
    sizes = {r.lang: r.n for r in held.groupBy("lang").agg(F.sum(F.when(~F.col("designs"), F.col("quality")).otherwise(0)).alias("n")).collect()}
    each = held.filter("designs").select("lang", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("x"))
    rows = each.groupBy("lang", "x.rule", "x.level").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()
    counts: dict[str, dict[tuple[str, int], tuple[int, int]]] = {}
    for r in rows:
        counts.setdefault(r.lang, {})[r.rule, r.level] = (r.good, r.bad)
    sequences = {lang: s for lang, c in counts.items() if (s := design(c, price))}
    if not sequences:
        return {}
    # For each stratum, rule and level the first set that rejects it.
    none = max(map(len, sequences.values()))

    def firsts(sets: list[dict[str, int]], rule: str) -> list[int]:
        return [next((i for i, s in enumerate(sets) if s.get(rule, -1) >= level), none) for level in range(len(GRID[rule]))] + [none]

    table = [(lang, *(firsts(sets, r) for r in RULES)) for lang, sets in sequences.items()]
    known = measured.sparkSession.createDataFrame(table, "lang string, " + ", ".join(f"f_{r} array<int>" for r in RULES))
    known = F.broadcast(known) if len(table) <= BROADCAST_STRATA else known
    first = F.least(*[F.get(f"f_{r}", F.col(r)) for r in RULES])
    tested = held.filter("not designs and quality = 1").join(known, "lang").groupBy("lang", first.alias("first")).agg(F.count("*").alias("n")).collect()
    rejected: dict[str, dict[int, int]] = {}
    for r in tested:
        rejected.setdefault(r.lang, {})[r["first"]] = r.n
    out = {}
    for lang, sets in sequences.items():
        held_sets = certified(len(sets), rejected.get(lang, {}), sizes.get(lang, 0), alpha, delta / len(sizes))
        if held_sets:
            out[lang] = {r: GRID[r][level] for r, level in sets[held_sets - 1].items()}
    return out


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rejected_by (names of the rules) for every row."""
    measured = staged(measure(docs), "measured")
    cutoffs = calibrate(measured, labels, **options)
    rows = [(lang, *(c.get(r) for r in RULES)) for lang, c in sorted(cutoffs.items())]
    table = measured.sparkSession.createDataFrame(rows, "lang string, " + ", ".join(f"c_{r} double" for r in RULES))
    table = F.broadcast(table) if len(rows) <= BROADCAST_STRATA else table
    tests = [F.when(F.col(r) > F.col(f"c_{r}"), F.lit(r)) for r in RULES]
    judged = measured.join(table, "lang", "left").withColumn("rejected_by", F.array_compact(F.array(*tests)))
    names = [c.split()[0] for c in BASE.split(", ")]
    return judged.select("doc_id", *names, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")

"""Resolving WARC revisit records: the as-of join of a not-modified capture to the latest earlier full response.

records: record_id, url, ts (long), kind ("response" or "revisit"), etag, last_modified, digest, headers (map); other columns
are not read.  The join key is the canonical URL.  A URL may hold a third of all records, so no task gets a whole URL: its
time line is cut into slices of about ``slice_rows`` records of the whole table, between quantiles of time, so that a stray
time shifts only the slices of one quantile.  A running maximum inside (URL, slice) is completed by the last response of
the slices before, from one summary row for each URL and slice.

A revisit is resolved if its validators agree with the response found: each of etag (weak comparison), last_modified
and digest that both records carry must be equal, and one at least must be carried by both.  Otherwise the response
is named but ``resolved`` is false.  Headers of the response are kept, and those a 304 may renew are taken from it.
A revisit without an earlier response has a null match; ties: a response at the revisit's time counts as
earlier, of responses at one time the greatest record id wins.  Records of null URL or null time match nothing; an empty URL
is a URL like others, a very long one too.  A response that repeats (one URL, time and id) counts once, the greatest by its
columns; a revisit that repeats is answered each time.  An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may renew (RFC 9110, section 15.4.5).
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
SLICE_ROWS = 50_000


#: Quantiles of time between which slices are of equal width.
QUANTILES = 64


def canonical(url: Column) -> Column:
    """Lower-cased host and the path as it is, without scheme, leading www, default port, fragment, tracking parameters, last slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(u, "^[^/?]*", 0)
    u = F.concat(F.lower(host), F.substring(u, F.length(host) + 1, F.length(u)))
    u = F.regexp_replace(u, r"^www[0-9]*\.", "")
    u = F.regexp_replace(u, r"^([^/?]*):(80|443)(?=[/?]|$)", "$1")
    u = F.regexp_replace(u, r"([?&])utm_[a-z]+=[^&]*", "$1")
    u = F.regexp_replace(u, r"&{2,}", "&")
    u = F.regexp_replace(u, r"\?&", "?")
    u = F.regexp_replace(u, r"[?&]+$", "")
    return F.regexp_replace(u, r"/+$", "")


def time_slice(records: DataFrame, slice_rows: int) -> Column:
    """Number of the slice of time of ``ts``; slices hold about ``slice_rows`` records and follow each other in time."""
    known = records.filter("ts is not null")
    n = known.count()
    parts = max(1, min(QUANTILES, -(-n // slice_rows)))
    bounds = known.approxQuantile("ts", [i / parts for i in range(parts + 1)], 0.25 / QUANTILES) if n else []
    edges = sorted({int(x) for x in bounds}) or [0]
    within = max(1, -(-n // (slice_rows * parts)))
    out = F.lit(-1).cast("long")
    for i, lo in enumerate(edges):
        width = max(1, -(-(edges[i + 1] - lo) // within)) if i + 1 < len(edges) else 1 << 62
        out = F.when(F.col("ts") >= lo, F.lit(i * within).cast("long") + F.least(F.floor((F.col("ts") - F.lit(lo)) / F.lit(width)), F.lit(within - 1))).otherwise(out)
    return out


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each revisit: record_id, url_key, ts, response_id, response_ts, resolved, headers."""
    fields = ["ts", "record_id", "etag", "last_modified", "digest", "headers"]
    keyed = records.filter("url is not null and ts is not null").select(canonical(F.col("url")).alias("url_key"), time_slice(records, slice_rows).alias("slice"), "kind", *fields)
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    summary = keyed.groupBy("url_key", "slice").agg(F.max(full).alias("last"))
    before = summary.select("url_key", "slice", F.max("last").over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    found = keyed.withColumn("own", F.max(full).over(within)).filter("kind = 'revisit'").join(before, ["url_key", "slice"], "left").withColumn("match", F.coalesce("own", "before"))
    rest = F.struct(*[F.col(c).alias(f"r_{c}") for c in fields[2:]])
    responses = keyed.filter("kind = 'response'").groupBy("url_key", F.col("ts").alias("r_ts"), F.col("record_id").alias("r_record_id"))
    responses = responses.agg(F.max_by(rest, F.to_json(rest)).alias("r")).select("url_key", "r_ts", "r_record_id", "r.*")
    # The response's own row is fetched by id and time, an equi-join of one row to each match.
    cond = [found.url_key == responses.url_key, found.match.ts == responses.r_ts, found.match.record_id == responses.r_record_id]
    joined = found.join(responses, cond, "left").select(found["*"], *[F.col(f"r_{c}") for c in fields])

    def agree(a: Column, b: Column) -> tuple[Column, Column]:
        both = a.isNotNull() & b.isNotNull()
        return both, ~both | (a == b)

    checks = [agree(_strong(F.col("etag")), _strong(F.col("r_etag"))), agree(F.col("last_modified"), F.col("r_last_modified")), agree(F.col("digest"), F.col("r_digest"))]
    some, every = checks[0]
    for b, e in checks[1:]:
        some, every = some | b, every & e
    resolved = F.coalesce(F.col("match").isNotNull() & some & every, F.lit(False))
    empty = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("headers", empty), lambda k, _: F.lower(k).isin(RENEWED))
    old = F.map_filter(F.coalesce("r_headers", empty), lambda k, _: ~F.array_contains(F.transform(F.map_keys(new), F.lower), F.lower(k)))
    merged = F.when(resolved, F.map_concat(old, new))
    matched = joined.select("record_id", "url_key", "ts", F.col("match.record_id").alias("response_id"), F.col("match.ts").alias("response_ts"), resolved.alias("resolved"), merged.alias("headers"))
    lost = records.filter("kind = 'revisit' and (url is null or ts is null)").select("record_id", canonical(F.col("url")).alias("url_key"), "ts")
    return matched.unionByName(lost.withColumn("resolved", F.lit(False)), allowMissingColumns=True)

"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, html_extract, language_id, license_scan, minhash_dedup, packing, quality, substring_dedup, toxicity, warc


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_packing(spark, sf):
    return packing.pack(_table(spark, sf, "documents"))


def op2_substring_dedup(spark, sf):
    return substring_dedup.substring_dedup(_table(spark, sf, "documents"))


def op3_toxicity(spark, sf):
    return toxicity.held_out_scores(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op4_minhash_dedup(spark, sf):
    return minhash_dedup.near_dedup(_table(spark, sf, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture history made from pages: every page is fetched in full once and asked for again later.

    The second visit comes a thousand steps after the first.  Every seventh visit carries another entity tag than the page had,
    so it must not resolve.
    """
    full = pages.select(
        F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.md5("html").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string")).alias("headers"),
    )
    stale = F.col("page_id") % 7 == 0
    again = pages.select(
        (-F.col("page_id") - 1).alias("record_id"), "url", (F.col("page_id") + 1000).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(stale, F.lit("changed")).otherwise(F.concat(F.lit("W/"), F.md5("html"))).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("date"), (F.col("page_id") + 1000).cast("string"), F.lit("server"), F.lit("s")).alias("headers"),
    )
    return full.unionByName(again)


def op5_warc_revisits(spark, sf):
    found = warc.resolve(captures(_table(spark, sf, "pages")))
    return found.select("record_id", "url_key", "ts", "response_id", "response_ts", "resolved", F.col("headers")["date"].alias("date"), F.col("headers")["content-type"].alias("content_type"), F.coalesce(F.size("headers"), F.lit(0)).alias("n_headers"))


def op6_html_extraction(spark, sf):
    return html_extract.main_text(_table(spark, sf, "pages"))


def op7_decontamination(spark, sf):
    found = decontaminate.decontaminate(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.drop("spans")


def op8_language_id(spark, sf):
    return language_id.held_out_languages(_table(spark, sf, "documents"))


def op9_quality_rules(spark, sf):
    found = quality.quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return found.withColumn("rejected_by", F.array_join("rejected_by", ","))


def op10_license_scan(spark, sf):
    return license_scan.scan(_table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_substring_dedup, op3_toxicity, op4_minhash_dedup, op5_warc_revisits, op6_html_extraction, op7_decontamination,
        op8_language_id, op9_quality_rules, op10_license_scan,
    )
}

_CANON = "trim(url)"
for _a, _b in (
    ("#.*$", ""), ("^[A-Za-z][A-Za-z0-9+.-]*://", ""), ("lower", ""), (r"^www[0-9]*\.", ""), (r"^([^/?]*):(80|443)$", r"\1"), (r"^([^/?]*):(80|443)([/?])", r"\1\3"),
    ("([?&])utm_[a-z]+=[^&]*", r"\1"), ("&{2,}", "&"), (r"\?&", "?"), ("[?&]+$", ""), ("/+$", ""),
):
    if _a == "lower":
        _CANON = f"lower(regexp_extract({_CANON}, '^[^/?]*')) || regexp_replace({_CANON}, '^[^/?]*', '')"
    else:
        _CANON = f"regexp_replace({_CANON}, '{_a}', '{_b}', 'g')"

ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM d),
win AS (SELECT doc_id, pos, w, count(*) OVER b AS n, string_agg(w, ' ') OVER b AS k FROM tok
        WINDOW b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
rep AS (SELECT doc_id, pos, w, n = 35 AND count(*) OVER (PARTITION BY k, n) > 1 AS r FROM win),
cov AS (SELECT doc_id, pos, w, bool_or(r) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM rep),
agg AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id""",
    "op5_warc_revisits": f"""
WITH p AS (SELECT page_id, {_CANON} AS url_key, md5(html) AS etag FROM pages WHERE url IS NOT NULL),
v AS (SELECT -page_id - 1 AS record_id, url_key, page_id + 1000 AS ts, CASE WHEN page_id % 7 = 0 THEN 'changed' ELSE etag END AS etag FROM p),
m AS (SELECT v.*, p.page_id AS response_id, p.etag AS r_etag FROM v ASOF LEFT JOIN p ON v.url_key = p.url_key AND v.ts >= p.page_id)
SELECT record_id, url_key, ts, response_id, response_id AS response_ts, coalesce(etag = r_etag, false) AS resolved,
  CASE WHEN etag = r_etag THEN ts::VARCHAR END AS date, CASE WHEN etag = r_etag THEN 'text/html' END AS content_type, CASE WHEN etag = r_etag THEN 2 ELSE 0 END AS n_headers
FROM m""",
    "op7_decontamination": r"""
WITH it AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM it WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS k FROM iw),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM d),
lst AS (SELECT doc_id, pos, list(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM tok),
cand AS (SELECT doc_id, pos, n, array_to_string(l[1:n], ' ') AS k FROM lst, (SELECT DISTINCT n FROM win) WHERE len(l) >= n),
occ AS (SELECT doc_id, pos, n, item_id FROM cand JOIN win USING (n, k)),
diag AS (SELECT doc_id, item_id, pos, n, pos - p AS g FROM cand JOIN (SELECT item_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS k FROM iw) USING (n, k)),
isl AS (SELECT doc_id, pos, n, item_id, g, pos - row_number() OVER (PARTITION BY doc_id, item_id, n, g ORDER BY pos) AS i FROM diag),
mat AS (SELECT doc_id, min(pos) AS s, max(pos) - min(pos) + n AS len FROM isl GROUP BY doc_id, item_id, n, g, i),
lng AS (SELECT doc_id, max(len) AS longest, arg_min(s, (-len, s)) AS s FROM mat GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS q FROM (SELECT DISTINCT doc_id, pos, n FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(longest, 0)::BIGINT AS longest_match, lng.s::BIGINT AS longest_start
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id LEFT JOIN lng ON lng.doc_id = d.doc_id""",
}

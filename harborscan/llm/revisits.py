"""WARC: not-modified revisits take the headers of the latest earlier full response of their canonical URL.

The as-of join is two-level, so that a URL with a third of all captures is not one task: captures of a URL are cut into
time buckets of about equal numbers of captures, whatever their times. Within a bucket a running maximum finds the latest earlier response; the last response of each bucket is
one row, and a running maximum over a URL's buckets (at most BUCKETS) serves revisits without one in their own. Bodies
take no part; only URL, time and header fields are shuffled.

A revisit is resolved if the response's validator agrees: the entity tag where both have one, else the modification
time. Of the revisit's headers only the permitted ones (date, cache_control, expires, etag) replace the response's.

Defined cases: null URLs have no canonical form and are never resolved; captures of the same time are not earlier than
each other; of several responses of the latest time the one of the highest page_id holds; repeated captures and those
without a page_id each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 128
#: Query fields that say where a visitor came from.
TRACKING = r"^(?i)(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
FIELDS = ("etag", "modified", "content_type", "content_length", "cache_control")


def canonical(url: Column) -> Column:
    """Host in lower case without www. and a default port, path without dot steps and a closing slash, query fields in
    order without tracking ones; no scheme and no fragment. Case counts in path and query."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www\\.", "")
    host = F.regexp_replace(host, F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise("^$"), F.lit(""))
    steps = F.filter(F.split(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1), "&"), lambda f: (f != "") & ~f.rlike(TRACKING)))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.concat(host, F.array_join(F.transform(walked, lambda p: F.concat(F.lit("/"), p)), ""), query)


def captures(pages: DataFrame) -> DataFrame:
    """A capture log from pages: every third page_id is a not-modified revisit, the rest are responses.

    Fields follow from the row: the entity tag from the canonical URL (for one revisit in five from the page as well, so
    that it disagrees), the modification time from the page_id, the type and length from the html.
    """
    canon = canonical(F.col("url"))
    revisit = F.pmod(F.col("page_id"), F.lit(3)) == 0
    tag = F.md5(F.when(revisit & (F.pmod(F.col("page_id"), F.lit(5)) == 0), F.concat(canon, F.col("page_id").cast("string"))).otherwise(canon))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), canon.alias("canonical"), F.col("page_id").cast("long").alias("time"), revisit.alias("revisit"),
        F.when(F.pmod(F.col("page_id"), F.lit(7)) > 0, F.substring(tag, 1, 12)).alias("etag"), F.floor(F.col("page_id") / 1000).cast("long").alias("modified"),
        F.when(~revisit, F.lit("text/html")).alias("content_type"), F.when(~revisit, F.octet_length("html").cast("long")).alias("content_length"),
        F.when(F.pmod(F.col("page_id"), F.lit(2)) == 0, F.concat(F.lit("max-age="), F.pmod(F.col("page_id"), F.lit(60)).cast("string"))).alias("cache_control"),
    )


def resolved(log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per revisit: page_id, canonical, response_id, status, etag, content_type, content_length, cache_control, lag.

    log: page_id, canonical, time, revisit and FIELDS.
    """
    shares = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(log.agg(F.percentile_approx("time", shares, 10_000)).first()[0] or []))  # fewer than ``buckets`` numbers
    full = F.when(~F.col("revisit"), F.struct("time", "page_id", *FIELDS))
    rows = log.where("canonical IS NOT NULL").withColumn("bucket", F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col("time"))))
    inside = Window.partitionBy("canonical", "bucket").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(full).over(inside)).where("revisit")
    last = rows.groupBy("canonical", "bucket").agg(F.max(full).alias("last"))
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("far", F.max("last").over(before)).select("canonical", "bucket", "far")
    joined = near.join(carried, ["canonical", "bucket"], "left").withColumn("r", F.coalesce("near", "far")).drop("near", "far")
    out = joined.unionByName(log.where("canonical IS NULL AND revisit"), allowMissingColumns=True)
    agrees = F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), F.col("etag") == F.col("r.etag")).otherwise(F.coalesce(F.col("modified") == F.col("r.modified"), F.lit(False)))
    status = F.when(F.col("r").isNull(), "no_earlier_response").when(agrees, "resolved").otherwise("validator_mismatch")
    done = out.withColumn("status", status).withColumn("ok", F.col("status") == "resolved")
    return done.select(
        "page_id", "canonical", F.col("r.page_id").alias("response_id"), "status",
        F.when(F.col("ok"), F.coalesce("etag", "r.etag")).alias("etag"), F.when(F.col("ok"), F.col("r.content_type")).alias("content_type"),
        F.when(F.col("ok"), F.col("r.content_length")).alias("content_length"), F.when(F.col("ok"), F.coalesce("cache_control", "r.cache_control")).alias("cache_control"),
        (F.col("time") - F.col("r.time")).alias("lag"),
    )


ORACLE = """
WITH c AS (
  SELECT page_id, html, host || CASE WHEN path = '' THEN '' ELSE '/' || path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM (
    SELECT page_id, html, regexp_replace(lower(split_part(split_part(rest, '/', 1), '?', 1)), '^www[.]', '') AS host,
      array_to_string(list_filter(string_split(array_to_string(string_split(split_part(rest, '?', 1), '/')[2:], '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path,
      coalesce(array_to_string(list_sort(list_filter(string_split(array_to_string(string_split(rest, '?')[2:], '?'), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref='))), '&'), '') AS query
    FROM (SELECT page_id, html, array_to_string(string_split(split_part(url, '#', 1), '://')[2:], '://') AS rest FROM pages))),
log AS (
  SELECT page_id, canonical, page_id % 3 = 0 AS revisit,
         CASE WHEN page_id % 7 > 0 THEN substr(md5(CASE WHEN page_id % 15 = 0 THEN canonical || page_id ELSE canonical END), 1, 12) END AS etag,
         page_id // 1000 AS modified, strlen(html) AS content_length,
         CASE WHEN page_id % 2 = 0 THEN 'max-age=' || (page_id % 60) END AS cache_control FROM c),
j AS (
  SELECT v.page_id, v.canonical, v.etag, v.modified, v.cache_control, r.page_id AS response_id, r.etag AS r_etag,
         r.modified AS r_modified, r.content_length, r.cache_control AS r_cache_control
  FROM (SELECT * FROM log WHERE revisit) v ASOF LEFT JOIN (SELECT * FROM log WHERE NOT revisit) r
    ON v.canonical = r.canonical AND v.page_id > r.page_id),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_earlier_response'
                 WHEN CASE WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN etag = r_etag ELSE modified = r_modified END THEN 'resolved'
                 ELSE 'validator_mismatch' END AS status FROM j)
SELECT page_id, canonical, response_id, status,
       CASE WHEN status = 'resolved' THEN coalesce(etag, r_etag) END AS etag,
       CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
       CASE WHEN status = 'resolved' THEN content_length END AS content_length,
       CASE WHEN status = 'resolved' THEN coalesce(cache_control, r_cache_control) END AS cache_control,
       page_id - response_id AS lag FROM s
"""

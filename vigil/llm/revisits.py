"""Resolving not-modified captures of a crawl (operator 9).

Records have record_id, url, ts (seconds), status, headers (map) and payload.
A full response has status 200 and a payload; a revisit has status 304. Each
revisit is joined, by canonical URL, to the latest earlier full response (ties
in time by record_id). The validators must agree: the ETag (weak comparison)
if the revisit has one, else Last-Modified. Then it takes the payload, and the
response's headers updated by those of its own that a 304 may change.

The as-of step moves small pointers only and is bucketed by day: inside a
bucket a window carries the last response forward, across buckets one row per
(URL, day) does, so a URL with a third of all captures is spread over its days.
Payloads move once, to the revisits that refer to them.

Records with null url, ts or id, or of another status, come back as ``other``.
Repeated rows come back as often as they came; of equal (ts, record_id) full
responses the last one in record order counts once. Null headers are empty; of
header names that differ in case only the first counts. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import write_table

DAY = 86_400

# Header fields that a 304 response may update (RFC 9111, 3.2 and RFC 9110, 15.4.5).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary")

# Query parameters that never change what a URL returns.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)="

_SCHEME = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?"


def canonical_url(url: Column) -> Column:
    """Host without www and default port in lower case, path without trailing
    slashes, sorted query without tracking; no scheme and no fragment."""
    host = F.lower(F.regexp_extract(url, _SCHEME + "([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(www[0-9]*\.)+", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _SCHEME + "[^/?#]*([^?#]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(params), "&"))).otherwise("")
    return F.concat(host, path, query)


def lower_names(headers: Column) -> Column:
    """Header entries with names in lower case, the first of equal ones."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(first), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def latest_responses(points: DataFrame) -> DataFrame:
    """(record_id, response_id) of the revisits in ``points`` (canon, ts,
    record_id, full) that have an earlier full response."""
    day = points.withColumn("day", F.floor(F.col("ts") / DAY))
    inside = Window.partitionBy("canon", "day").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("full"), F.col("record_id"))
    rows = day.withColumn("near", F.last(own, ignorenulls=True).over(inside)).where("NOT full")
    ends = day.where("full").groupBy("canon", "day").agg(F.max(F.struct("ts", "record_id"))["record_id"].alias("last"))
    marks = ends.select("canon", "day", "last").unionByName(
        rows.select("canon", "day", F.lit(None).cast("long").alias("last")).distinct())
    marks = marks.groupBy("canon", "day").agg(F.max("last").alias("last"))
    before = Window.partitionBy("canon").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.withColumn("far", F.last("last", ignorenulls=True).over(before)).select("canon", "day", "far")
    found = rows.join(carry, ["canon", "day"], "left").withColumn("response_id", F.coalesce("near", "far"))
    return found.where("response_id IS NOT NULL").select("record_id", "response_id").distinct()


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per record: record_id, canonical_url, kind (response, revisit, other),
    outcome, response_id, headers (merged) and payload."""
    known = F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    kind = (F.when(known & (F.col("status") == 200) & F.col("payload").isNotNull(), "response")
            .when(known & (F.col("status") == 304), "revisit").otherwise("other"))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", kind.alias("kind"),
                          lower_names(F.col("headers")).alias("headers"), "payload")
    points = rows.where("kind <> 'other'").select(F.col("canonical_url").alias("canon"), "ts", "record_id", (F.col("kind") == "response").alias("full"))
    near = write_table(latest_responses(points), "revisit-links")
    full = rows.where("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), F.col("payload").alias("body"))
    full = full.dropDuplicates(["response_id"])
    again = rows.where("kind = 'revisit'").drop("payload").join(near, "record_id", "left").join(full, "response_id", "left")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    new, old = F.col("headers"), F.col("stored")
    agrees = F.when(new["etag"].isNotNull(), weak(new["etag"]).eqNullSafe(weak(old["etag"]))).otherwise(
        new["last-modified"].isNotNull() & new["last-modified"].eqNullSafe(old["last-modified"]))
    outcome = F.when(F.col("stored").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    update = F.map_filter(new, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    again = again.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "kind", "outcome", "response_id",
        F.when(F.col("outcome") == "resolved", merged).otherwise(new).alias("headers"),
        F.when(F.col("outcome") == "resolved", F.col("body")).alias("payload"))
    rest = rows.where("kind <> 'revisit'").select(
        "record_id", "canonical_url", "kind", F.lit("stored").alias("outcome"),
        F.when(F.col("kind") == "response", F.col("record_id")).alias("response_id"), "headers", "payload")
    return rest.unionByName(again)


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def crawl_log(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a full response, and some days later a
    conditional request that is answered 304 (with changed validators for some
    pages, Last-Modified only for others, under another spelling of the URL)."""
    ident = F.col("page_id").cast("long")
    stamp = lambda s: F.concat(F.lit("t"), s.cast("string"))
    tag = F.concat(F.lit('"'), F.md5(F.col("html")), F.lit('"'))
    seen, later = ident * 60, ident * 60 + DAY * (1 + F.pmod(ident, F.lit(5)))
    header = lambda *kv: F.map_from_arrays(F.array(*(F.lit(k) for k in kv[::2])), F.array(*kv[1::2]))
    full = pages.select(
        (ident * 2).alias("record_id"), "url", seen.alias("ts"), F.lit(200).alias("status"),
        header("Content-Type", F.lit("text/html"), "Content-Length", F.length("html").cast("string"), "ETag", tag,
               "Last-Modified", stamp(seen), "Date", stamp(seen), "Cache-Control", F.lit("max-age=60")).alias("headers"),
        F.col("html").alias("payload"))
    other = F.concat(F.regexp_replace(F.col("url"), "^https?://", "HTTP://WWW."), F.when(F.col("url").contains("#"), "").otherwise("#again"))
    same = F.when(F.pmod(ident, F.lit(7)) == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    by_tag = header("ETag", same, "Date", stamp(later), "Content-Length", F.lit("0"), "Cache-Control", F.lit("max-age=120"))
    by_time = header("Last-Modified", stamp(seen), "Date", stamp(later), "Content-Length", F.lit("0"), "Cache-Control", F.lit("max-age=120"))
    again = pages.select(
        (ident * 2 + 1).alias("record_id"), other.alias("url"), later.alias("ts"), F.lit(304).alias("status"),
        F.when(F.pmod(ident, F.lit(11)) == 0, by_time).otherwise(by_tag).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(again)


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both captures of every page, the second one resolved."""
    found = resolve_revisits(crawl_log(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select("record_id", "canonical_url", "kind", "outcome", "response_id", header_text(F.col("headers")).alias("headers"),
                        F.sha2("payload", 256).alias("payload_sha256"))


OP9_SQL = r"""
WITH p AS (SELECT page_id AS id, html, url, regexp_replace(url, '^https?://', '') AS u FROM pages),
c AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^([^/?#]*)', 1)), '^www[0-9]*\.', '') ||
   regexp_replace(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS base,
   list_sort(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'),
     lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)='))) AS q FROM p),
k AS (SELECT id, html, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canon,
   id * 60 AS seen, id * 60 + 86400 * (1 + id % 5) AS later FROM c),
a AS (SELECT r.id, r.canon, r.seen, r.later, f.id AS fid, f.html, f.seen AS fseen, r.html AS own FROM k r ASOF LEFT JOIN
   (SELECT * FROM k) f ON r.canon = f.canon AND r.later > f.seen),
v AS (SELECT *, CASE WHEN fid IS NULL THEN 'no_response' WHEN id % 11 = 0 THEN CASE WHEN fseen = seen THEN 'resolved' ELSE 'validator_mismatch' END
   WHEN id % 7 <> 0 AND md5(own) = md5(html) THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM a)
SELECT id * 2 AS record_id, canon AS canonical_url, 'response' AS kind, 'stored' AS outcome, id * 2 AS response_id,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || length(html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || seen
  || chr(10) || 'etag: "' || md5(html) || '"' || chr(10) || 'last-modified: t' || seen AS headers, sha256(html) AS payload_sha256 FROM k
UNION ALL
SELECT id * 2 + 1, canon, 'revisit', outcome, fid * 2,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || length(html) || chr(10) || 'content-type: text/html'
    || chr(10) || 'date: t' || later || chr(10) || 'etag: ' || CASE WHEN id % 11 = 0 THEN '' ELSE 'W/' END || '"' || md5(html) || '"' || chr(10)
    || 'last-modified: t' || fseen
  ELSE 'cache-control: max-age=120' || chr(10) || 'content-length: 0' || chr(10) || 'date: t' || later || chr(10) ||
    CASE WHEN id % 11 = 0 THEN 'last-modified: t' || seen WHEN id % 7 = 0 THEN 'etag: "changed"' ELSE 'etag: W/"' || md5(own) || '"' END END,
  CASE WHEN outcome = 'resolved' THEN sha256(html) END FROM v
"""

"""Operator 10: WARC revisit records resolved against the latest earlier full response.

A ``revisit`` record with the not-modified profile has no body: the server
answered 304. :func:`resolve_revisits` finds, by an as-of join on the
canonical URL, the latest full response at or before its time, checks the
validators (a revisit's ETag or Last-Modified must fit the response's, and a
``refers-to`` digest must be its payload digest), and merges headers: the
response's, replaced by those a 304 may carry (``UPDATABLE``).

The as-of join needs no window over a whole URL's history: the records of a
URL are dealt to time slices of ``SLICE_SECONDS``; within a slice a window
finds the latest response, and what earlier slices leave behind is a window
over one row per slice. So a URL with a third of all records is spread over
its slices. Only keys and validators are sorted. What is found depends on URL
and time alone, so it is joined back by these, one row each; headers of the
responses are fetched afterwards by all the facts of the response. Record ids
may be null or shared.

Edge cases: records with a null URL or time, and revisits without an earlier
response or with another validator, stay with a null target and say why in
``status``; ties in time are broken by record id, the larger is later, and
a response comes before a revisit of the same time; every revisit row gives one
row, equal ones are resolved alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

SLICE_SECONDS = 86_400
#: Headers that a 304 response may bring up to date (RFC 9110, section 15.4.5).
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Query parameters that only trace a visitor.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
COLUMNS = ("record_id", "warc_type", "target_uri", "warc_time", "payload_digest", "headers")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a closing slash removed; host in lower case.

    What is left of the query keeps its order. Null stays null.
    """
    rest = F.regexp_replace(url, r"(?s)#.*$", "")
    rest = F.regexp_replace(rest, r"^(?i:[a-z][a-z0-9+.-]*://)?(?:[^/?@]*@)?", "")
    host = F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/$", "")
    query = F.concat(F.lit("&"), F.regexp_extract(rest, r"(?s)\?(.*)$", 1))
    query = F.regexp_replace(F.regexp_replace(query, rf"&{TRACKING}=[^&]*", ""), r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The value of a header in a map of lower-case names; null if missing."""
    return F.try_element_at(headers, F.lit(name))


def _keys(records: DataFrame, *carry: str) -> DataFrame:
    full = (F.col("warc_type") == "response")
    return records.select(
        "record_id", canonical_url(F.col("target_uri")).alias("url"), F.col("warc_time").cast("timestamp").alias("at"),
        (F.col("warc_type") == "revisit").alias("revisit"), full.alias("full"),
        F.col("payload_digest").alias("digest"), header(F.col("headers"), "etag").alias("etag"),
        header(F.col("headers"), "last-modified").alias("modified"), *carry)


def latest_earlier(keys: DataFrame) -> DataFrame:
    """(url, at, target) of the revisits: the latest full response of their URL that is not later; one row a URL and time."""
    facts = F.struct("record_id", "at", "digest", "etag", "modified")
    rows = keys.where((F.col("revisit") | F.col("full")) & F.col("url").isNotNull() & F.col("at").isNotNull()) \
               .withColumn("slice", F.floor(F.unix_timestamp("at") / SLICE_SECONDS)) \
               .withColumn("response", F.when(F.col("full"), facts))
    ends = rows.where("full").groupBy("url", "slice").agg(F.max(F.struct("at", "record_id", "response")).alias("end"))
    both = rows.select("url", "slice").where("revisit").distinct().withColumn("asked", F.lit(True)) \
               .join(ends, ["url", "slice"], "full_outer")
    carried = both.select("url", "slice", "asked", F.last("end.response", ignorenulls=True).over(
        Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("before")) \
        .where("asked AND before IS NOT NULL").select("url", "slice", "before")
    within = rows.withColumn("here", F.last("response", ignorenulls=True).over(
        Window.partitionBy("url", "slice").orderBy("at", F.col("revisit"), "record_id", "response")
        .rowsBetween(Window.unboundedPreceding, 0))).where("revisit")
    return within.join(carried, ["url", "slice"], "left").groupBy("url", "at").agg(F.max(F.coalesce("here", "before")).alias("target"))


def _status(etag: Column, modified: Column, digest: Column, target: Column) -> Column:
    return F.when(target.isNull(), "no response") \
            .when(etag.isNotNull() & target["etag"].isNotNull() & (etag != target["etag"]), "etag differs") \
            .when(etag.isNull() & modified.isNotNull() & target["modified"].isNotNull() & (modified != target["modified"]), "date differs") \
            .when(digest.isNotNull() & target["digest"].isNotNull() & (digest != target["digest"]), "digest differs") \
            .otherwise("resolved")


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, those of UPDATABLE that the revisit has taken from it."""
    empty = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce(revisit, empty), lambda k, v: k.isin(*UPDATABLE) & v.isNotNull())
    kept = F.map_filter(F.coalesce(response, empty), lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, new)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record of ``records`` (COLUMNS; headers: map of lower-case names).

    ``record_id, url, warc_time, status, target_id, target_time,
    payload_digest`` (the target's) and ``headers`` (merged; the revisit's
    own where it is not resolved). ``target_id`` is the response whose body
    stands for the missing one.
    """
    records = records.select(*[records[c] for c in COLUMNS])
    found = latest_earlier(_keys(records)).select(F.col("url").alias("f_url"), F.col("at").alias("f_at"), "target")
    revisits = _keys(records.where(F.col("warc_type") == "revisit"), "warc_time", "headers")
    joined = revisits.join(found, (F.col("url") == F.col("f_url")) & (F.col("at") == F.col("f_at")), "left")
    judged = joined.select(
        "record_id", "url", "warc_time", F.col("headers").alias("own"), "target",
        F.when(F.col("url").isNull() | F.col("at").isNull(), "no url or time")
         .otherwise(_status(F.col("etag"), F.col("modified"), F.col("digest"), F.col("target"))).alias("status"))
    resolved = F.col("status") == "resolved"
    judged = judged.withColumn("wanted", F.when(resolved, F.xxhash64("url", "target"))).withColumn("target", F.when(resolved, F.col("target")))
    facts = F.struct("record_id", "at", "digest", "etag", "modified")
    bodies = _keys(records.where(F.col("warc_type") == "response"), "headers") \
        .select(F.xxhash64("url", facts).alias("r_key"), F.col("url").alias("r_url"), facts.alias("r_facts"), F.col("headers").alias("r_headers"))
    bodies = bodies.join(judged.select(F.col("wanted").alias("r_key")).distinct(), "r_key", "left_semi")
    # of equal responses whose other headers differ, one stands for all
    bodies = bodies.groupBy("r_key", "r_url", "r_facts").agg(F.min_by("r_headers", F.to_json("r_headers")).alias("r_headers"))
    here = (F.col("wanted") == F.col("r_key")) & (F.col("url") == F.col("r_url")) & F.col("target").eqNullSafe(F.col("r_facts"))
    return judged.join(bodies, here, "left").select(
        "record_id", "url", "warc_time", "status", F.col("target.record_id").alias("target_id"), F.col("target.at").alias("target_time"),
        F.col("target.digest").alias("payload_digest"), F.when(resolved, merge_headers(F.col("r_headers"), F.col("own"))).otherwise(F.col("own")).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records as a crawl over the given pages would leave them, one response and up to two revisits a page.

    Each page is fetched at a time taken from its id; every second page is
    asked for again a day later and every third some hours later, answered
    by 304 with the page's validator, or, for every seventh, with another.
    Where pages share a canonical URL the as-of join has to choose.
    """
    html = F.coalesce("html", F.lit(""))
    at = F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)) * 7919, F.lit(30 * 86_400))
    etag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))
    http_date = lambda t: F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def record(kind: str, suffix: int, time: Column, tag: Column) -> Column:
        own = [F.lit("etag"), tag, F.lit("date"), http_date(time)]
        if kind == "response":
            own += [F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(html).cast("string")]
        return F.struct((F.col("page_id") * 3 + suffix).alias("record_id"), F.lit(kind).alias("warc_type"), F.col("url").alias("target_uri"),
                        F.timestamp_seconds(time).alias("warc_time"),
                        (F.sha2(html, 256) if kind == "response" else F.lit(None).cast("string")).alias("payload_digest"),
                        F.create_map(*own).alias("headers"))

    other = F.when(F.col("page_id") % 7 == 0, F.lit('"gone"')).otherwise(etag)
    rows = F.array(record("response", 0, at, etag),
                   F.when(F.col("page_id") % 2 == 0, record("revisit", 1, at + 86_400, other)),
                   F.when(F.col("page_id") % 3 == 0, record("revisit", 2, at + 14_400, etag)))
    return pages.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisits of the crawl derived from all pages, resolved; header maps as sorted text."""
    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", (F.col("record_id") / 3).cast("long").alias("page_id"), "url", "status", "target_id",
                      F.unix_timestamp("target_time").alias("target_seconds"), "payload_digest", text.alias("headers"))


ORACLE = r"""
WITH pages2 AS (
    SELECT page_id, url, coalesce(html, '') AS html, 1700000000 + (coalesce(page_id, 0) * 7919) % 2592000 AS secs FROM pages),
rows AS (
    SELECT page_id * 3 + k AS record_id, page_id, url, k, html, secs + CASE k WHEN 0 THEN 0 WHEN 1 THEN 86400 ELSE 14400 END AS secs,
           CASE WHEN k = 1 AND page_id % 7 = 0 THEN '"gone"' ELSE '"' || substr(md5(html), 1, 16) || '"' END AS etag
    FROM pages2, (VALUES (0), (1), (2)) t(k) WHERE k = 0 OR (k = 1 AND page_id % 2 = 0) OR (k = 2 AND page_id % 3 = 0)),
rest AS (SELECT *, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^(?:(?i)[a-z][a-z0-9+.-]*://)?(?:[^/?@]*@)?', '') AS u FROM rows),
split AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(?:80|443)$', ''), '^www\.', '') AS host,
           regexp_replace(regexp_extract(u, '(?s)^[^/?]*([^?]*)', 1), '/$', '') AS path,
           regexp_replace(regexp_replace('&' || regexp_extract(u, '(?s)\?(.*)$', 1), '&(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query
    FROM rest),
canon AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM split),
ranked AS (
    SELECT v.record_id, v.page_id, v.canonical, v.etag, v.secs, r.record_id AS r_id, r.secs AS r_secs, r.etag AS r_etag, r.html AS r_html,
           row_number() OVER (PARTITION BY v.record_id ORDER BY r.secs DESC, r.record_id DESC) AS n
    FROM canon v LEFT JOIN canon r ON r.k = 0 AND r.canonical = v.canonical AND r.secs <= v.secs WHERE v.k > 0),
judged AS (SELECT *, CASE WHEN r_id IS NULL THEN 'no response' WHEN etag <> r_etag THEN 'etag differs' ELSE 'resolved' END AS status FROM ranked WHERE n = 1)
SELECT record_id, page_id, canonical AS url, status, CASE WHEN status = 'resolved' THEN r_id END AS target_id,
       CASE WHEN status = 'resolved' THEN r_secs END AS target_seconds, CASE WHEN status = 'resolved' THEN sha256(r_html) END AS payload_digest,
       CASE WHEN status = 'resolved' THEN 'content-length: ' || strlen(r_html) || chr(10) || 'content-type: text/html' || chr(10) ELSE '' END
       || 'date: ' || strftime(make_timestamp(secs * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'etag: ' || etag AS headers
FROM judged
"""

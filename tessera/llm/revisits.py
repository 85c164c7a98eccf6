"""WARC revisit resolution: not-modified captures find the full response they stand for.

An as-of join by canonical URL: each revisit takes the latest full response
captured before it, or at the same time with a smaller record id. If the
validators both have disagree, the response isn't the one the server meant, and
the revisit stays unresolved. Otherwise the stored headers are updated by those
of the revisit, but for the ones a not-modified answer may not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Header fields that stay as stored (RFC 9111, 3.2; RFC 9110, 7.6.1 and 8).
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that only track where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme left out, host in lower case without www and default port, path without trailing slash, query sorted without tracking, no fragment."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(plain, "(?i)^https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def lower_keys(headers: Column) -> Column:
    """Entries with lower-case names, the last of equal names."""
    entries = F.map_entries(F.coalesce(headers, F.expr("map()").cast("map<string,string>")))
    return F.aggregate(
        entries,
        F.expr("map()").cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def merged_headers(stored: Column, update: Column) -> Column:
    permitted = F.map_filter(update, lambda k, _: ~k.isin(*NOT_UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), '^[Ww]/', "")


def as_of(records: DataFrame, slices: int | None = None) -> DataFrame:
    """``records`` (url_key, ts, record_id, is_full, facts) with ``found``, the facts of the latest full one before.

    A URL may hold any share of the rows, so they are cut by range of (url_key,
    ts, record_id), each slice is filled forward by itself, and a slice's first
    rows take what the nearest slice before it ended with. Only one row for each
    slice and URL that goes on across its border is looked at a second time.
    """
    from pyspark.sql.window import Window

    n = slices or max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(records.repartitionByRange(n, "url_key", "ts", "record_id").withColumn("_slice", F.spark_partition_id()))
    here = Window.partitionBy("_slice", "url_key").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranged.withColumn("_own", F.last(F.when(F.col("is_full"), F.col("facts")), True).over(here))
    last = ranged.where("is_full").groupBy("url_key", "_slice").agg(F.max_by("facts", F.struct("ts", "record_id")).alias("_last"))
    touched = ranged.select("url_key", "_slice").distinct()
    ends = touched.join(last, ["url_key", "_slice"], "left")
    before = Window.partitionBy("url_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_last", True).over(before)).where("_carried is not null").select("url_key", "_slice", "_carried")
    return filled.join(carried, ["url_key", "_slice"], "left").withColumn("found", F.coalesce("_own", "_carried")).drop("_own", "_carried", "_slice")


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row for each revisit: record_id, url_key, status, original_id, headers.

    ``records`` has record_id, url, ts, status (304 or revisit profiles: 304),
    headers map<string,string>; a full response is one of status 200. Rows with
    null record_id, url or ts take no part, and other statuses neither find nor
    are found. status is 'resolved', 'mismatch' (ETag, compared weakly, or
    else Last-Modified differ) or 'missing' (no earlier full response); only
    the first has original_id and merged headers. Repeated rows stay repeated;
    bodies and other columns are not read; an empty table gives an empty table.
    """
    rows = records.select("record_id", "url", "ts", "status", "headers").where("record_id is not null and url is not null and ts is not null and status in (200, 304)")
    headers = lower_keys(F.col("headers"))
    rows = rows.select(canonical_url(F.col("url")).alias("url_key"), "ts", "record_id", (F.col("status") == 200).alias("is_full"), headers.alias("headers"))
    rows = rows.withColumn("facts", F.struct("record_id", "headers"))
    found = as_of(rows, slices).where(~F.col("is_full"))
    mine, theirs = F.col("headers"), F.col("found.headers")
    both = lambda name: mine[name].isNotNull() & theirs[name].isNotNull()
    differs = F.when(both("etag"), weak(mine["etag"]) != weak(theirs["etag"])).when(both("last-modified"), F.trim(mine["last-modified"]) != F.trim(theirs["last-modified"])).otherwise(F.lit(False))
    status = F.when(F.col("found").isNull(), "missing").when(differs, "mismatch").otherwise("resolved")
    found = found.withColumn("outcome", status)
    good = F.col("outcome") == "resolved"
    return found.select("record_id", "url_key", F.col("outcome").alias("status"), F.when(good, F.col("found.record_id")).alias("original_id"), F.when(good, merged_headers(theirs, mine)).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC-like records made from ``pages``, as the tables hold no captures.

    Each page gives a full response at hour page_id and a 304 at hour 3 *
    page_id / 2 under another spelling of its URL; by page_id every seventh has
    another ETag, every fifth has none but a date, and every eleventh comes
    before the page itself.
    """
    etag = F.concat(F.lit('"'), F.md5(F.col("html")), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    size = F.length("html").cast("string")
    kind, length, tag, since, server, age = (F.lit(x) for x in ("Content-Type", "Content-Length", "ETag", "Last-Modified", "Server", "Age"))
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 3600).alias("ts"), F.lit(200).alias("status"), F.create_map(kind, F.lit("text/html"), length, size, tag, etag, since, date, server, F.lit("first")).alias("headers"))
    later = F.when(F.col("page_id") % 11 == 0, F.col("page_id") * 3600 - 1).otherwise(F.floor(F.col("page_id") * 5400).cast("long") + 1)
    named = F.when(F.col("page_id") % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), etag))
    dated = F.create_map(since, date, length, F.lit("0"), server, F.lit("second"))
    tagged = F.create_map(tag, named, length, F.lit("0"), server, F.lit("second"), age, F.lit("1"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), later.alias("ts"), F.lit(304).alias("status"), F.when(F.col("page_id") % 5 == 0, dated).otherwise(tagged).alias("headers"))
    return full.unionAll(again)

"""Not-modified revisits of a web archive, resolved to the full response that they stand for.

A revisit record carries no body: the server said that nothing changed. It takes the body of the latest response for
the same canonical URL that was stored before it, provided that their validators agree, and the headers of that
response updated by its own, as a cache does with a 304.

``records`` has record_id (unique), kind (``response`` or ``revisit``; other kinds are ignored), url, at (long, seconds),
etag, last_modified, headers (map, names in any case) and digest (of the body).

* A response at the very second of the revisit is not earlier. Of responses at one second the larger record_id is later.
* Entity tags compare weakly (``W/`` is dropped) and decide if both sides have one; else Last-Modified decides; without
  a common validator the two agree only if neither side has any.
* status: ``resolved``, ``mismatch`` (the latest earlier response has other validators) or ``orphan`` (there is none, or
  the URL is null). source_id and digest are null unless resolved; headers are then the revisit's own.
* Null headers count as none. Times that are null never match.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.runs import last_known

#: Headers of the stored body and of one connection: a not-modified answer must not replace them.
KEPT_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "content-location", "transfer-encoding", "connection", "keep-alive", "trailer", "upgrade")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
CHUNK_SECONDS = 512


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a final slash, query without tracking and in order; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    site = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    return F.concat(site, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then agree, the last value stays."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(lowered, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(lowered, lambda e: e["key"] == n), -1)["value"]))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with those of the not-modified answer that may replace them."""
    allowed = F.map_filter(fresh, lambda name, _: ~name.isin(*KEPT_HEADERS))
    rest = F.map_filter(stored, lambda name, _: ~F.map_contains_key(allowed, name))
    return F.map_concat(rest, allowed)


def _agree(a_tag: Column, a_date: Column, b_tag: Column, b_date: Column) -> Column:
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    by_tag, by_date = a_tag.isNotNull() & b_tag.isNotNull(), a_date.isNotNull() & b_date.isNotNull()
    none = a_tag.isNull() & b_tag.isNull() & a_date.isNull() & b_date.isNull()
    return F.when(by_tag, weak(a_tag) == weak(b_tag)).when(by_date, a_date == b_date).otherwise(none)


def resolve_revisits(records: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """One row per revisit: record_id, canonical_url, at, status, source_id, digest and merged headers.

    The as-of join is a forward fill along time per URL, cut into spans of ``chunk_seconds``, so that no task holds all
    records of one URL. Bodies stay where they are; join them by source_id.
    """
    rows = records.where(F.col("kind").isin("response", "revisit") & F.col("at").isNotNull())
    rows = rows.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), F.col("at").cast("long").alias("at"), "etag", "last_modified",
        _lower_names(F.col("headers")).alias("headers"), "digest", (F.col("kind") == "response").cast("int").alias("_full"),
    )
    stored = F.struct("record_id", "etag", "last_modified", "headers", "digest")
    rows = rows.withColumn("_stored", F.when((F.col("_full") == 1) & F.col("canonical_url").isNotNull(), stored))
    keyless = F.struct("canonical_url", F.when(F.col("canonical_url").isNull(), F.col("record_id")).alias("alone"))
    rows = rows.withColumn("_key", keyless)
    filled = last_known(rows, ["_key"], ["at", "_full", "record_id"], F.floor(F.col("at") / chunk_seconds), {"_found": "_stored"})
    found = filled.where("_full = 0")
    same = _agree(F.col("etag"), F.col("last_modified"), F.col("_found.etag"), F.col("_found.last_modified"))
    status = F.when(F.col("_found").isNull(), "orphan").when(same, "resolved").otherwise("mismatch")
    hit = status == "resolved"
    lost = records.where((F.col("kind") == "revisit") & F.col("at").isNull()).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.lit(None).cast("long").alias("at"), F.lit("orphan").alias("status"),
        F.lit(None).cast(dict(records.dtypes)["record_id"]).alias("source_id"), F.lit(None).cast("string").alias("digest"), _lower_names(F.col("headers")).alias("headers"),
    )
    return found.select(
        "record_id", "canonical_url", "at", status.alias("status"), F.when(hit, F.col("_found.record_id")).alias("source_id"),
        F.when(hit, F.col("_found.digest")).alias("digest"), F.when(hit, merged_headers(F.col("_found.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    ).unionByName(lost)


def records_of(pages: DataFrame) -> DataFrame:
    """Archive records of a table of pages: every page is fetched at second page_id, and asked for again later.

    Some servers send an entity tag (a weak one in part), others a date. The second answer is a revisit with the
    validators of the first.
    """
    day = F.concat(F.lit("day "), F.pmod(F.col("page_id"), F.lit(7)).cast("string"))
    tag = F.concat(F.when(F.pmod(F.col("page_id"), F.lit(5)) == 0, "W/").otherwise(""), F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    tagged = F.pmod(F.col("page_id"), F.lit(3)) > 0
    rows = pages.select(
        "page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("n")
    ).withColumns({"etag": F.when(tagged, tag), "last_modified": F.when(~tagged, day)})
    validators = F.map_concat(
        F.when(tagged, F.create_map(F.lit("ETag"), F.col("etag"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(~tagged, F.create_map(F.lit("Last-Modified"), F.col("last_modified"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    later = F.col("page_id") + 1 + F.pmod(F.col("page_id") * 7919, F.lit(1000))
    first = F.map_concat(validators, F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("n").cast("string"), F.lit("Date"), F.col("page_id").cast("string"),
    ))
    second = F.map_concat(validators, F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), later.cast("string"), F.lit("Age"), F.lit("0")))
    fetched = rows.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("at"), "etag", "last_modified", first.alias("headers"), "digest")
    again = rows.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("at"), "etag", "last_modified", second.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return fetched.unionByName(again)

"""WARC: resolving not-modified revisits.

A revisit record of a 304 answer has no body; what it stands for is the latest
earlier full response of the same canonical URL, if the validators agree. The
answer's permitted headers replace those of the response.

The as-of join splits hot URLs. Records are dealt by ranges of (URL, time), so a
URL with a third of all records lies in many ranges; each range finds its own
latest response, and for records that begin a range the last response of earlier
ranges is carried over, one row per URL and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargohold.llm.common import written

#: Fixed value: headers that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that track visits and don't name content; and ports that schemes have anyway.
TRACKING = r"^(utm_[^=]*|fbclid|gclid)(=|$)"
PORTS = {"http": 80, "https": 443}


def canonical_url(url: Column, merge_hosts: bool = False, ignored_params: str | None = TRACKING) -> Column:
    """Host and path without scheme, the scheme's own port, fragment, trailing slashes and ignored parameters; host lower-cased, parameters sorted.

    merge_hosts: also without a leading www. or m., for crawls that know them to
    be the same. ignored_params: a pattern of `name=value`, None to keep all.
    Null for null and blank URLs.
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    for scheme, port in PORTS.items():
        whole = F.regexp_replace(whole, f"^((?i){scheme}://[^/?]*):{port}(?=[/?]|$)", "$1")
    bare = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(host, r"^(www|m)\.", "") if merge_hosts else host
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & (~p.rlike(ignored_params) if ignored_params else F.lit(True)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(params), "&"))).otherwise("")
    return F.nullif(F.concat(host, path, query), F.lit(""))


def strong_tag(etag: Column) -> Column:
    """An entity tag without the mark of a weak one: 304 answers compare weakly."""
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, names in lower case, with the permitted ones of the revisit in their place. Null maps are empty."""

    def lowered(m: Column) -> Column:
        entries = F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))
        return F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    new = F.filter(lowered(revisit), lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(new, lambda e: e["key"])
    kept = F.filter(lowered(response), lambda e: ~F.array_contains(names, e["key"]))
    # names that repeat within one map up to case: the last wins
    both = F.concat(kept, new)
    indexed = F.transform(both, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i")))
    last = F.filter(indexed, lambda e: ~F.exists(indexed, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def resolved_revisits(records: DataFrame, partitions: int | None = None, merge_hosts: bool = False, ignored_params: str | None = TRACKING) -> DataFrame:
    """One row per revisit record: record_id, url (canonical), response_id, outcome, headers.

    records: record_id long, url string, ts (any ordered type), kind ("response"
    or "revisit"; others are ignored), etag and last_modified string, headers
    map<string,string>; where there are such columns also status int and
    truncated string.

    response_id is the latest earlier full response by (ts, record_id): one with
    status 200 and not truncated, as far as the columns are there. URLs are
    compared by canonical_url. outcome:
    "resolved" if the entity tags agree, or where one has none, the last-modified
    dates; "mismatch" if they differ; "unverified" if neither can be compared;
    "no_response" if there is none. headers are merged if resolved, else those of
    the revisit.

    Nulls: without URL or time a revisit has no response, and such responses
    match nothing; null record_ids are first among equal times. Records that
    repeat are records each. Empty tables give an empty result; URLs of any
    length count whole. Other columns are not read.
    """
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = F.col("kind") == "response"
    if "status" in records.columns:
        full &= F.col("status").eqNullSafe(200)
    if "truncated" in records.columns:
        full &= F.coalesce(F.col("truncated"), F.lit("")) == ""
    base = records.filter((F.col("kind") == "revisit") | full).select("record_id", canonical_url(F.col("url"), merge_hosts, ignored_params).alias("url"), "ts", "kind", "etag", "last_modified", "headers")
    keyed = base.filter(F.col("url").isNotNull() & F.col("ts").isNotNull())
    ranged = written(keyed.repartitionByRange(n, "url", "ts", "record_id").withColumn("part", F.spark_partition_id()), "captures")
    answer = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    ranged = ranged.withColumn("answer", answer)
    # within a range; a null record_id sorts first
    before = Window.partitionBy("part", "url").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("found", F.last("answer", ignorenulls=True).over(before)).filter("kind = 'revisit'")
    at_end = F.max_by("answer", F.struct("ts", "record_id"))
    ends = ranged.filter("kind = 'response'").groupBy("part", "url").agg(at_end.alias("answer"))
    # every range that a URL has, so that each gets the last response before it
    spans = ranged.groupBy("part", "url").agg(F.count("*").alias("n")).join(ends, ["part", "url"], "left")
    carry = spans.select("part", "url", F.last("answer", ignorenulls=True).over(Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")).filter("carried IS NOT NULL")
    matched = inside.join(carry, ["part", "url"], "left").withColumn("found", F.coalesce("found", "carried"))
    lost = base.filter((F.col("url").isNull() | F.col("ts").isNull()) & (F.col("kind") == "revisit")).withColumn("found", F.lit(None).cast(inside.schema["found"].dataType))
    columns = ["record_id", "url", "etag", "last_modified", "headers", "found"]
    every = matched.select(columns).unionByName(lost.select(columns))
    tags = strong_tag(F.col("etag")) == strong_tag(F.col("found.etag"))
    same = F.coalesce(tags, F.col("last_modified") == F.col("found.last_modified"))
    outcome = F.when(F.col("found").isNull(), "no_response").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    every = every.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome") == "resolved", merged_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return every.select("record_id", "url", F.col("found.record_id").alias("response_id"), "outcome", headers.alias("headers"))


def header_lines(headers: Column) -> Column:
    """A map as sorted lines `name: value`."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")

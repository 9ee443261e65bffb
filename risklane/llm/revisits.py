"""Not-modified revisits of a web archive, resolved by an as-of join to the latest earlier full response.

A revisit record says that a page was as before; this module finds the response that it stands for. Records of one
canonical URL are put in order of time. Ordering is global (URL, time), dealt out by range, so a URL with any share of all
records is spread over many tasks: each slice scans its own records and takes over the last response that earlier
slices of the same URL have seen, of which there is at most one a slice. Bodies never move; headers are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risklane.llm.common import let, stage

# Headers of a 304 that must not replace those of the stored response (connection-bound ones, and those that describe a body).
NOT_MERGED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
              "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type",
              "content-md5")
# Fixed value: query parameters that only track where a reader came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical(url: Column) -> Column:
    """One spelling per page: no scheme, lower-case host without ``www.`` and default port, no fragment, no tracking
    parameters, the others sorted, no slash at the end. Null stays null."""
    plain = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def strong(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def lowered(headers: Column) -> Column:
    """Headers with names in lower case; of names that then agree, the last one counts."""
    named = F.transform(F.map_entries(headers), lambda h: F.struct(F.lower(h["key"]).alias("key"), h["value"].alias("value")))

    def last_of_each(every: Column) -> Column:
        again = lambda h, i: F.exists(F.slice(every, i + 2, F.size(every)), lambda later: later["key"] == h["key"])
        return F.map_from_entries(F.filter(every, lambda h, i: ~again(h, i)))

    return let(named, last_of_each)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, updated by those headers of the revisit that may replace them, sorted by name."""
    allowed = F.map_filter(fresh, lambda name, _: ~name.isin(*NOT_MERGED))
    kept = F.map_filter(stored, lambda name, _: ~F.map_contains_key(allowed, name))
    return F.array_sort(F.concat(F.map_entries(kept), F.map_entries(allowed)))


def as_of(records: DataFrame) -> DataFrame:
    """``records`` (key, at, rank, record_id, found) with ``seen``: the last non-null ``found`` of the key before the row.

    Rows of a key are in order of (at, rank, record_id).
    """
    order = ["key", "at", "rank", "record_id"]
    slices = stage(records.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "slices")
    ends = slices.filter("found is not null").groupBy("_slice", "key").agg(
        F.max_by("found", F.struct("at", "rank", "record_id")).alias("_end"))
    starts = slices.groupBy("_slice", "key").agg(F.lit(1).alias("_one")).join(ends, ["_slice", "key"], "left")
    earlier = W.partitionBy("key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = starts.select(F.col("_slice").alias("_c"), F.col("key").alias("_k"),
                            F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).filter("_carried is not null")
    inside = W.partitionBy("_slice", "key").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, -1)
    # A slice continues at most one key, so there are no more rows to carry than slices.
    return slices.withColumn("_own", F.last("found", ignorenulls=True).over(inside)) \
        .join(F.broadcast(carried), (F.col("_slice") == F.col("_c")) & (F.col("key") == F.col("_k")), "left") \
        .withColumn("seen", F.coalesce("_own", "_carried")).select(*records.columns, "seen")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, at, kind, status, headers map<string,string>).

    ``outcome``: ``resolved``; ``no_response`` when no full response (kind response, status 200) with that canonical URL
    is strictly earlier, and for a null URL or time; ``no_validator`` when the revisit has neither an entity tag nor a date
    of change; ``changed`` when its tag (or, without one, its date) is not the response's. Only resolved revisits have a
    response and merged headers. Of responses at the same time the greater record id is the later one. Null headers
    count as none; of header names that differ in case only, the last one counts. Repeated revisits are resolved alike, an empty
    table gives an empty result, and other columns are ignored.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    found = records.select(
        F.col("record_id"), canonical(F.col("url")).alias("key"), F.col("at"), F.col("kind"),
        F.coalesce(lowered(F.col("headers")), none).alias("headers"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"))
    lines = found.filter(F.col("key").isNotNull() & F.col("at").isNotNull() & (F.col("full") | (F.col("kind") == "revisit")))
    ranked = lines.select("key", "at", F.when(F.col("kind") == "revisit", 0).otherwise(1).alias("rank"), "record_id", "kind", "headers",
                          F.when(F.col("full"), F.struct("record_id", "at", "headers")).alias("found"))
    met = as_of(ranked).filter("kind = 'revisit'").select("record_id", "key", "at", "headers", "seen")
    lost = found.filter((F.col("kind") == "revisit") & (F.col("key").isNull() | F.col("at").isNull())) \
        .select("record_id", "key", "at", "headers").withColumn("seen", F.lit(None).cast(met.schema["seen"].dataType))
    rows = met.unionByName(lost)
    tag, date = F.col("headers")["etag"], F.col("headers")["last-modified"]
    same = F.when(tag.isNotNull(), strong(tag) == strong(F.col("seen.headers")["etag"])) \
        .otherwise(date == F.col("seen.headers")["last-modified"])
    outcome = F.when(F.col("seen").isNull(), "no_response").when(tag.isNull() & date.isNull(), "no_validator") \
        .when(F.coalesce(same, F.lit(False)), "resolved").otherwise("changed")
    good = F.col("outcome") == "resolved"
    return rows.withColumn("outcome", outcome).select(
        "record_id", F.col("key").alias("canonical_url"), "at", "outcome",
        F.when(good, F.col("seen.record_id")).alias("response_id"), F.when(good, F.col("seen.at")).alias("response_at"),
        F.when(good, F.array_join(F.transform(
            merged_headers(F.col("seen.headers"), F.col("headers")),
            lambda h: F.concat(h["key"], F.lit(": "), F.coalesce(h["value"], F.lit("")))), "\n")).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """An archive of two records per page: its response, and a revisit 20 time steps later under another spelling of its URL.

    Times follow the page ids, so pages with one canonical URL come between a response and its revisit. A null page id gives
    records without id and time, a null page one of size 0; repeated pages give repeated records.
    """
    text = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id"), "url", F.md5(text).alias("tag"), F.octet_length(text).cast("string").alias("size"))
    day = (F.col("page_id") % 28 + 1).cast("string")

    def headers(**values: Column) -> Column:
        return F.create_map(*[part for name, value in values.items() for part in (F.lit(name.replace("_", "-")), value)])

    first = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("at"), F.lit("response").alias("kind"),
        F.when(F.col("page_id") % 11 == 10, 404).otherwise(200).alias("status"),
        headers(ETag=F.col("tag"), Last_Modified=day, Content_Length=F.col("size"), Cache_Control=F.lit("max-age=60")).alias("headers"))
    tag = F.when(F.col("page_id") % 4 == 0, F.col("tag")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("W/"), F.col("tag"))) \
        .when(F.col("page_id") % 8 == 2, F.lit("other"))
    second = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#seen")).alias("url"),
        (F.col("page_id") * 10 + 20).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.map_filter(headers(etag=tag, last_modified=F.when(F.col("page_id") % 4 == 3, day), content_length=F.lit("0"),
                             cache_control=F.lit("max-age=90"), age=F.lit("5")), lambda _, v: v.isNotNull()).alias("headers"))
    return first.unionByName(second)

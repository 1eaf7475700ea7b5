"""Not-modified revisits of a crawl, resolved to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.llm.common import written

#: Revisits of one response from which on it is copied, and the number of responses of which that may be true.
HOT, HOT_KEYS = 500, 100_000
#: The header fields that a 304 answer must carry where a 200 would, and so may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name a way to a page, not the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical(url: Column) -> Column:
    """Without scheme, www or m, default port, fragment, tracking parameters and a last slash; host in lower case,
    parameters in order. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^/]*)", 1)), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(/.*)$", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lowered(headers: Column) -> Column:
    """The header map with names in lower case; of names that differ in case only, the last one's value."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers, with the permitted ones of the revisit in their place."""
    new = F.map_filter(revisit, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def resolve(captures: DataFrame, slice_width: int = 3600) -> DataFrame:
    """captures (record_id, url, ts long, kind 'response' or 'revisit', headers map, payload) to one row a revisit.

    record_id, canonical_url, response_id, status, headers and payload. The response is the latest strictly before the
    revisit; of those of one URL and time, the one with the largest id, then validators, then hash of headers and payload,
    so ids need not be unique. status: resolved (every validator, ETag without its weak mark and Last-Modified, that both
    have is equal), unchecked (they share none), changed (one differs), orphan (no earlier response, or a null URL or
    time). Only resolved and unchecked ones get a payload; others keep their own headers. Null ids, headers and payloads
    are as good as any; an empty URL is a URL. Repeated rows are resolved each; no revisit gives no rows. Extra columns
    are not read.

    Places are found without payloads. Time is cut into slices: the latest response of each URL and slice is aggregated,
    carried on over the few rows a URL has then, and a slice's own rows are ordered within it, so a URL that holds a third
    of all captures is spread over its slices. Payloads join at the end, each shuffled once; a response with more than HOT
    revisits is copied to as many salts as they need.
    """
    h = F.col("_h")
    c = captures.select("record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "kind", lowered(F.col("headers")).alias("_h"), "payload")
    c = c.withColumn("_etag", F.regexp_replace(h["etag"], r"^W/", "")).withColumn("_modified", h["last-modified"])
    c = c.withColumn("_hash", F.xxhash64("record_id", "payload", F.array_sort(F.map_entries(h))))
    is_revisit, placed = F.col("kind") == "revisit", F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    place = c.where(placed & F.col("kind").isin("response", "revisit")).select("canonical_url", F.floor(F.col("ts") / slice_width).alias("_slice"), "ts", "kind", "record_id", F.when(~is_revisit, F.struct("ts", "record_id", "_etag", "_modified", "_hash")).alias("_r"), "_etag", "_modified", "_hash", F.when(is_revisit, h).alias("_h"))
    last = place.where(~is_revisit).groupBy("canonical_url", "_slice").agg(F.max("_r").alias("_last"))
    slices = place.select("canonical_url", "_slice").distinct().join(last, ["canonical_url", "_slice"], "left")
    by_slice = Window.partitionBy("canonical_url").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("canonical_url", "_slice", F.last("_last", ignorenulls=True).over(by_slice).alias("_carried"))
    # All responses before a row's time, none of its own time.
    within = Window.partitionBy("canonical_url", "_slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = place.withColumn("_own", F.max("_r").over(within)).where(is_revisit).join(slices, ["canonical_url", "_slice"])
    found = found.withColumn("_at", F.coalesce("_own", "_carried"))

    def compare(x: Column, y: Column) -> Column:
        return F.when(x.isNotNull() & y.isNotNull(), x == y)

    etag, modified = compare(F.col("_etag"), F.col("_at._etag")), compare(F.col("_modified"), F.col("_at._modified"))
    status = F.when(F.col("_at").isNull(), "orphan").when(F.coalesce(etag, F.lit(True)) & F.coalesce(modified, F.lit(True)), F.when(etag.isNull() & modified.isNull(), "unchecked").otherwise("resolved")).otherwise("changed")
    found = written(found.select("record_id", "canonical_url", F.col("_at.record_id").alias("response_id"), status.alias("status"), h.alias("_own_h"), F.col("_at.ts").alias("_ts"), F.col("_at._hash").alias("_hash"), F.xxhash64("ts", "_hash").alias("_salt")))
    good, key = found.where(F.col("status").isin("resolved", "unchecked")), ["canonical_url", "_ts", "_hash"]
    # No more than HOT_KEYS rows, whatever the input, as each stands for so many revisits.
    most = max(HOT, good.count() // HOT_KEYS + 1)
    hot = F.broadcast(good.groupBy(*key).agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("_parts")).where("_parts > 2"))
    parts = F.coalesce("_parts", F.lit(1))
    good = good.join(hot, key, "left").withColumn("_salt", F.pmod("_salt", parts).cast("int"))
    responses = c.where((F.col("kind") == "response") & placed).select("canonical_url", F.col("ts").alias("_ts"), "_hash", h.alias("_response_h"), "payload").join(hot, key, "left")
    responses = responses.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).dropDuplicates([*key, "_salt"])
    got = good.join(responses, [*key, "_salt"]).select("record_id", "canonical_url", "response_id", "status", merged(F.col("_response_h"), F.col("_own_h")).alias("headers"), "payload")
    none = F.lit(None).cast(captures.schema["payload"].dataType)
    other = found.where(~F.col("status").isin("resolved", "unchecked")).select("record_id", "canonical_url", "response_id", "status", F.col("_own_h").alias("headers"), none.alias("payload"))
    lost = c.where(is_revisit & ~placed).select("record_id", "canonical_url", F.lit(None).cast(captures.schema["record_id"].dataType).alias("response_id"), F.lit("orphan").alias("status"), h.alias("headers"), none.alias("payload"))
    return got.unionByName(other).unionByName(lost)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl with revisits, from (page_id, url, html): every page answered in full at its id as time, and asked for
    once more, with the same validator or another one, later or, for some, before."""
    etag = F.md5(F.coalesce("html", F.lit("")))
    full = pages.select((2 * F.col("page_id")).alias("record_id"), "url", (60 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"), F.create_map(F.lit("ETag"), etag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"), F.col("html").alias("payload"))
    again = F.when(F.col("page_id") % 9 == 0, 60 * F.col("page_id") - 1).otherwise(60 * F.col("page_id") + 1 + 997 * (F.col("page_id") % 97))
    said = F.when(F.col("page_id") % 5 == 0, F.md5(F.col("page_id").cast("string"))).otherwise(etag)
    not_modified = pages.select((2 * F.col("page_id") + 1).alias("record_id"), "url", again.alias("ts"), F.lit("revisit").alias("kind"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), said), F.lit("Date"), F.concat(F.lit("r"), F.col("page_id").cast("string")), F.lit("Content-Type"), F.lit("none")).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(not_modified)


def digest(pages: DataFrame) -> DataFrame:
    found = resolve(captures_of_pages(pages))
    names = F.array_sort(F.map_keys("headers"))
    return found.select("record_id", "canonical_url", "response_id", "status", F.array_join(F.transform(names, lambda n: F.concat_ws("=", n, F.element_at("headers", n))), ";").alias("headers"), F.md5("payload").alias("payload_md5"))

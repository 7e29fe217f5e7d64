"""Resolution of not-modified revisit records (operator 2).

Each revisit is joined, as of its time and by canonical URL, to the latest earlier full response; their validators are
compared, and the headers of the revisit that a not-modified answer may change are merged into the response's. The as-of join
is a running last value over time. So that no URL's history has to be one task, a history is cut into spans of time: the last
response of each span is combined before the shuffle, carried on from span to span over these few rows, and joined to the
rows of the next span, which run on their own. URLs that are busy within a span have shorter spans, down to a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions, table

SPAN_SECONDS = 3600
#: Rows of a URL within a span up to which the span is never cut.
LEAST_BUSY = 4096
#: Fields that a 304 answer does not change in a stored response (RFC 9111, 3.1 and 3.2).
NOT_PERMITTED = (
    "connection", "content-encoding", "content-length", "content-range", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, utm parameters and a last slash; host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, r"([?&])utm_[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&+", "&"), r"\?&", "?")
    return F.concat(host, F.regexp_replace(rest, r"[?&/]+$", ""))


def lower_names(headers: Column) -> Column:
    """The map with its names in lower case; of names that then are equal the last one counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def resolve(captures: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """One row for each revisit: record_id, url (canonical), response_id, status and headers.

    ``captures`` has record_id, uri, at (long, seconds), type (``response`` or ``revisit``), etag, last_modified and headers
    (map of strings; names are compared and returned in lower case). The response is the latest one strictly before the revisit's time; of several at
    that time the one with the largest record_id, null ids first. status: ``no_response``; ``changed`` when a validator
    present on both sides differs (weak etags compare without their mark); ``no_validator`` when none is on both sides;
    ``resolved``. Only a resolved row has merged headers. Rows with a null uri, time or type are passed over, except that a
    revisit among them is returned with ``no_response``. Repeated rows give repeated rows; other columns are ignored.
    """
    rows = captures.select(
        F.col("record_id").alias("id"), canonical_url(F.col("uri")).alias("url"), F.col("at").cast("long").alias("at"), F.col("type").alias("kind"),
        F.regexp_replace("etag", "^W/", "").alias("etag"), "last_modified", lower_names(F.col("headers")).alias("headers"),
    )
    usable = F.col("url").isNotNull() & F.col("at").isNotNull()
    lost = rows.where((F.col("kind") == "revisit") & ~usable)
    rows = rows.where(usable & F.col("kind").isin("response", "revisit"))
    # A URL with more rows in one span than a quarter of a mean partition gets shorter spans; there are at most four such for each partition.
    busy = rows.groupBy("url", F.floor(F.col("at") / span_seconds).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    limit = max(LEAST_BUSY, rows.count() / (4 * partitions(captures.sparkSession)))
    busy = busy.where(F.col("n") > limit).groupBy("url").agg(F.max("n").alias("n"))
    short = busy.select("url", F.greatest(F.lit(1), (F.lit(span_seconds) * limit / F.col("n")).cast("long")).alias("width"))
    rows = rows.join(F.broadcast(short), "url", "left").withColumn("span", F.floor(F.col("at") / F.coalesce("width", F.lit(span_seconds)))).drop("width")
    full = F.when(F.col("kind") == "response", F.struct("at", "id", "etag", "last_modified", "headers"))
    rank = F.struct("at", "id", "etag", "last_modified", F.array_sort(F.map_entries("headers")).alias("h"))
    last = rows.where("kind = 'response'").groupBy("url", "span").agg(F.max_by(full, rank).alias("own"))
    # The last response before each span: its rows are few, one for each URL and span.
    spans = rows.groupBy("url", "span").agg(F.count(F.lit(1)).alias("n")).join(last, ["url", "span"], "left")
    before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("url", "span", F.last("own", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("url", "span").orderBy("at", F.desc("kind"), "id", "etag", "last_modified").rowsBetween(Window.unboundedPreceding, -1)
    # 'revisit' sorts before 'response' at equal times, so a response counts as earlier only if it is strictly earlier.
    own = F.last(full, ignorenulls=True).over(order)
    found = (
        rows.withColumn("seen", own)
        .where("kind = 'revisit'")
        .join(carried, ["url", "span"])
        .withColumn("r", F.coalesce("seen", "carried"))
        .drop("seen", "carried")
    )
    etags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    differ = (etags & (F.col("etag") != F.col("r.etag"))) | (times & (F.col("last_modified") != F.col("r.last_modified")))
    status = F.when(F.col("r").isNull(), "no_response").when(differ, "changed").when(~etags & ~times, "no_validator").otherwise("resolved")
    update = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*NOT_PERMITTED))
    stored = F.map_filter(F.coalesce("r.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.col("update"), k))
    out = found.withColumn("status", status).withColumn("update", update).withColumn("stored", stored)
    merged = F.when(F.col("status") == "resolved", F.map_concat("stored", "update"))
    none = F.lit(None).cast("map<string,string>")
    out = out.select(F.col("id").alias("record_id"), "url", F.col("r.id").alias("response_id"), "status", merged.alias("headers"))
    return out.unionByName(lost.select(F.col("id").alias("record_id"), "url", F.lit(None).cast(out.schema["response_id"].dataType).alias("response_id"), F.lit("no_response").alias("status"), none.alias("headers")))


def page_captures(pages: DataFrame) -> DataFrame:
    """A capture log over the pages table: for each page a full response and a later revisit under another spelling of its URL."""
    html = F.coalesce("html", F.lit(""))
    i = F.col("page_id")
    shared = pages.where("page_id IS NOT NULL").select(
        "page_id", "url", F.concat(F.lit('"'), F.md5(html), F.lit('"')).alias("tag"), F.char_length(html).cast("string").alias("size")
    )
    response = shared.select(
        (i * 2).alias("record_id"), F.col("url").alias("uri"), (i * 10).alias("at"), F.lit("response").alias("type"),
        F.when(i % 11 != 0, F.col("tag")).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-length"), F.col("size"), F.lit("content-type"), F.lit("text/html"), F.lit("date"), (i * 10).cast("string")).alias("headers"),
    )
    later = i * 10 + F.when(i % 13 == 0, -5).otherwise(7 + (i % 5) * 5000)
    revisit = shared.select(
        (i * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", r"#.*$", ""), F.lit("#again")).alias("uri"), later.alias("at"), F.lit("revisit").alias("type"),
        F.when(i % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag"))).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("connection"), F.lit("close"), F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string")).alias("headers"),
    )
    return response.unionByName(revisit)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(page_captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(lines, "; "))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id AS i, url, '"' || md5(coalesce(html, '')) || '"' AS tag, CAST(length(coalesce(html, '')) AS VARCHAR) AS size,
         page_id * 10 + CASE WHEN page_id % 13 = 0 THEN -5 ELSE 7 + (page_id % 5) * 5000 END AS later,
         regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare
  FROM pages WHERE page_id IS NOT NULL
), c AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
         || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''),
              '([?&])utm_[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS u
  FROM p
), j AS (
  SELECT r.i * 2 + 1 AS record_id, r.u AS url, r.i AS ri, r.tag AS rtag, r.later, s.i AS si, s.tag AS stag, s.size AS ssize
  FROM c r ASOF LEFT JOIN (SELECT *, i * 10 AS sat FROM c) s ON r.u = s.u AND r.later > s.sat
), t AS (
  SELECT *, CASE WHEN si IS NULL THEN 'no_response'
                 WHEN si % 11 = 0 THEN 'no_validator'
                 WHEN ri % 7 = 0 OR rtag <> stag THEN 'changed'
                 ELSE 'resolved' END AS status
  FROM j
)
SELECT record_id, url, si * 2 AS response_id, status,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60; content-length: ' || ssize
         || '; content-type: text/html; date: ' || CAST(later AS VARCHAR) END AS headers
FROM t
"""

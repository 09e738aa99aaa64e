"""WARC: not-modified revisits resolved by an as-of join to the latest earlier full response of the same canonical URL.

Everything is DataFrame expressions. Captures of one URL may be a third of all rows, so the as-of join isn't one window a
URL: each URL's captures are cut into spans of time; a window inside (URL, span) finds the latest full response there, and
a second one, over one row a span, carries the last full response of earlier spans in. Only ids and times travel through
the windows; the payload of the response is joined by its id at the end.

Header rules (RFC 9111, 304 responses update stored headers): fields of the revisit win, fields that only the response
has stay, and fields that describe the payload are taken from the response alone.

Defined results: a null URL matches nothing; a revisit without an earlier full response is `unresolved`; one whose
validator (ETag, else Last-Modified, else payload digest) differs from the response's is `mismatch`; without validators on
either side it is `unverified` and merged; ties in time are broken by record id. Each revisit row, repeated or without a
record id, has one result row; a response that is repeated counts once (of differing copies the one of least digest and
payload hash), one without a record id can't be named and is passed over. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that describe the payload or the connection, never taken from a 304.
NOT_UPDATED = (
    "content-encoding content-length content-range content-type transfer-encoding connection keep-alive "
    "proxy-authenticate proxy-authorization proxy-connection te trailer upgrade"
).split()
#: Records to a span of time, were all of one URL.
SPAN_ROWS = 20_000


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or m., no scheme, port, fragment, trailing slash or default page; query kept."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"(/index\.html?)?/?$", "")
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), rest)


def merge_headers(response: Column, revisit: Column) -> Column:
    """Header maps (names in lower case) of a stored response and of its 304; what the 304's Connection names is its own."""
    hop = F.split(F.regexp_replace(F.lower(F.coalesce(F.try_element_at(revisit, F.lit("connection")), F.lit(""))), r"\s", ""), ",")
    fresh = F.map_filter(revisit, lambda k, v: ~k.isin(*NOT_UPDATED) & ~F.array_contains(hop, k))
    stored = F.map_filter(response, lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_concat(stored, fresh)


def resolve_revisits(records: DataFrame, spans: int | None = None) -> DataFrame:
    """Revisits of records (record_id, url, at, kind 'response' or 'revisit', headers map, digest, payload) resolved.

    Returns record_id, canonical, response_id, status, headers, payload for each revisit.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "at", "kind", "headers", "digest", "payload"
    )
    slim = rows.select("record_id", "canonical", "at", "kind").where(F.col("canonical").isNotNull())
    bounds = slim.agg(F.min("at").cast("double").alias("lo"), F.max("at").cast("double").alias("hi"), F.count("*").alias("n"))
    many = F.ceil(F.col("n") / SPAN_ROWS) if spans is None else F.lit(spans)
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / many)
    slim = slim.crossJoin(F.broadcast(bounds)).withColumn(  # one row
        "span", F.coalesce(F.least(F.floor((F.col("at").cast("double") - F.col("lo")) / width), many - 1), F.lit(0)).cast("int")
    )
    order = ("at", F.expr("kind = 'revisit'"), "record_id")
    full = F.when((F.col("kind") == "response") & F.col("record_id").isNotNull(), F.struct("at", "record_id"))
    inside = Window.partitionBy("canonical", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = slim.select("record_id", "at", "canonical", "span", "kind", F.last(full, ignorenulls=True).over(inside).alias("own")).where("kind = 'revisit'")
    ends = slim.where("kind = 'response' and record_id is not null").groupBy("canonical", "span").agg(F.max(F.struct("at", "record_id")).alias("end"))
    spans_of = near.select("canonical", "span").distinct().join(ends, ["canonical", "span"], "full")
    before = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans_of.select("canonical", "span", F.last("end", ignorenulls=True).over(before).alias("carried"))
    # one row for what repeated records have in common; they meet it again by id, time and URL
    found = (
        near.join(carried, ["canonical", "span"], "left")
        .groupBy(F.col("record_id").alias("f_id"), F.col("at").alias("f_at"), F.col("canonical").alias("f_canonical"))
        .agg(F.max(F.coalesce("own", "carried")).alias("best"))
        .select("f_id", "f_at", "f_canonical", F.col("best.record_id").alias("response_id"), F.col("best.at").alias("response_at"))
    )
    visits = rows.where("kind = 'revisit'").select(
        "record_id", "at", "canonical", F.col("headers").alias("h2"), F.col("digest").alias("d2")
    )
    same = visits["record_id"].eqNullSafe(found["f_id"]) & visits["at"].eqNullSafe(found["f_at"]) & (visits["canonical"] == found["f_canonical"])
    visits = visits.join(found, same, "left").drop("f_id", "f_at", "f_canonical", "at")
    stored = rows.where("kind = 'response' and record_id is not null").select(
        F.col("record_id").alias("response_id"), F.col("at").alias("response_at"), F.col("headers").alias("h1"), F.col("digest").alias("d1"), "payload"
    )
    copies = Window.partitionBy("response_id", "response_at").orderBy("d1", F.xxhash64("payload"), F.to_json("h1"))
    stored = stored.withColumn("copy", F.row_number().over(copies)).where("copy = 1").drop("copy")
    h = lambda side, name: F.try_element_at(F.col(side), F.lit(name))
    left = F.coalesce(h("h1", "etag"), h("h1", "last-modified"), F.col("d1"))
    by = F.when(h("h1", "etag").isNotNull() & h("h2", "etag").isNotNull(), h("h1", "etag").eqNullSafe(h("h2", "etag")))
    by = by.when(h("h1", "last-modified").isNotNull() & h("h2", "last-modified").isNotNull(), h("h1", "last-modified") == h("h2", "last-modified"))
    by = by.when(F.col("d1").isNotNull() & F.col("d2").isNotNull(), F.col("d1") == F.col("d2"))
    status = (
        F.when(F.col("response_id").isNull(), "unresolved").when(by.isNull() | left.isNull(), "unverified").when(by, "resolved").otherwise("mismatch")
    )
    good = F.col("status").isin("resolved", "unverified")
    return (
        visits.join(stored, ["response_id", "response_at"], "left")
        .withColumn("status", status)
        .select(
            "record_id",
            "canonical",
            "response_id",
            "status",
            F.when(good, merge_headers(F.coalesce("h1", F.create_map().cast("map<string,string>")), F.coalesce("h2", F.create_map().cast("map<string,string>")))).alias("headers"),
            F.when(good, F.col("payload")).alias("payload"),
        )
    )


def page_records(pages: DataFrame) -> DataFrame:
    """`pages` as a crawl: every page is a capture at page_id seconds. A URL seen before with the same language and path
    comes as a revisit in three of four captures; its validators are those of a daily version of the page."""
    n = F.col("page_id")
    full = F.pmod(n, F.lit(4)) == 0
    version = F.md5(F.concat_ws("|", canonical_url(F.col("url")), F.floor(n / 5000).cast("string")).cast("binary"))
    headers = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("etag"), F.when(F.pmod(n, F.lit(3)) != 2, version)),
                F.struct(F.lit("date"), n.cast("string")),
                F.struct(F.lit("content-type"), F.when(full, F.lit("text/html"))),
                F.struct(F.lit("content-length"), F.when(full, F.length("html").cast("string")).otherwise(F.lit("0"))),
                F.struct(F.lit("server"), F.when(full, F.lit("origin"))),
            ),
            lambda x: x["col2"].isNotNull(),
        )
    )
    return pages.select(
        n.alias("record_id"),
        "url",
        n.alias("at"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        headers.alias("headers"),
        F.when(full, F.md5(F.col("html").cast("binary"))).alias("digest"),
        F.when(full, F.col("html")).alias("payload"),
    )


def revisit_report(pages: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return resolve_revisits(page_records(pages)).select(
        "record_id",
        "canonical",
        "response_id",
        "status",
        shown.alias("headers"),
        F.length("payload").cast("long").alias("payload_chars"),
        F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )


#: The same by a correlated subquery, without spans.
REPORT_SQL = r"""
WITH p AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's') AS bare FROM pages
), c AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
      || regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1), '(/index\.html?)?/?$', '') AS canonical
  FROM p
), r AS (
  SELECT page_id, canonical, html, page_id % 4 = 0 AS is_full,
    CASE WHEN page_id % 3 <> 2 THEN md5(canonical || '|' || CAST(CAST(floor(page_id / 5000.0) AS BIGINT) AS VARCHAR)) END AS etag
  FROM c
), f AS (
  SELECT v.page_id, v.canonical, v.etag AS etag2,
    (SELECT max(s.page_id) FROM r s WHERE s.is_full AND s.canonical = v.canonical AND s.page_id < v.page_id) AS response_id
  FROM r v WHERE NOT v.is_full
), j AS (
  SELECT f.*, s.etag AS etag1, s.html,
    CASE WHEN response_id IS NULL THEN 'unresolved' WHEN s.etag IS NULL OR etag2 IS NULL THEN 'unverified'
         WHEN s.etag = etag2 THEN 'resolved' ELSE 'mismatch' END AS status
  FROM f LEFT JOIN r s ON s.page_id = f.response_id
)
SELECT page_id AS record_id, canonical, response_id, status,
  CASE WHEN status IN ('resolved', 'unverified') THEN
    'content-length=' || CAST(length(html) AS VARCHAR) || ';content-type=text/html;date=' || CAST(page_id AS VARCHAR)
      || CASE WHEN coalesce(etag2, etag1) IS NOT NULL THEN ';etag=' || coalesce(etag2, etag1) ELSE '' END || ';server=origin' END AS headers,
  CASE WHEN status IN ('resolved', 'unverified') THEN CAST(length(html) AS BIGINT) END AS payload_chars,
  CASE WHEN status IN ('resolved', 'unverified') THEN md5(html) END AS payload_md5
FROM j
"""

"""WARC: revisit records with a not-modified profile are resolved to the response they stand for.

A revisit says that a server answered 304 to a conditional request, so its payload is that of the latest earlier full
response of the same canonical URL. That response is found by an as-of join; then the validators are checked, and the
stored headers are brought up to date with the ones that a 304 may carry.

*As-of join.* Only ids, times and validators take part; bodies are fetched by id afterwards. Captures of one URL are cut
into spans of ``span`` units of time: within a span a window carries the latest response forward; of earlier spans only
the last response of each is passed on, one row a span. A URL that holds a third of all captures is
thus many groups, and nothing is paired with all of its past.

*Validators.* A strong ``etag`` has to be equal if the revisit has one; failing that, ``last_modified`` if it has one;
a payload digest, if the revisit carries one, has to be equal as well. Without any validator nothing speaks against the
response. Weak tags (``W/``) are compared without the mark.

Defined results: a revisit without an earlier full response is ``unresolved``; one whose validators differ is
``mismatch`` and still names the response it was held against; captures at the same time are in order of record id, so
of two responses the larger id is the latest one; records without URL or time are never matched, as responses neither;
null validators and headers are absent ones; rows that repeat an id are captures of their own, and equal ones resolve to
one row; an empty table gives an empty one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response sends on to the stored one (RFC 9110), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Parameters that only track where a visitor came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, http and https alike, without www., default port, fragment, tracking and last slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, f"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    bare = F.regexp_replace(bare, "[?&]+$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z]+://[^/?]*(.*)$", 1), "/+($|\\?)", "$1")
    return F.when(F.length(host) > 0, F.concat(host, path)).otherwise(bare)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def as_of(records: DataFrame, span: int) -> DataFrame:
    """Each revisit with ``earlier``: the latest full response before it, or null."""
    full = F.when(~F.col("revisit"), F.struct("captured", "record_id", "etag", "last_modified", "digest", "headers"))
    cut = records.withColumn("span", F.floor(F.col("captured") / span)).withColumn("full", full)
    last = cut.where("NOT revisit").groupBy("canonical", "span").agg(F.max_by("full", F.struct("captured", "record_id")).alias("last"))
    spans = cut.select("canonical", "span").distinct().join(last, ["canonical", "span"], "left")
    before = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("canonical", "span", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("canonical", "span").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("revisit")
    return near.join(spans, ["canonical", "span"], "left").withColumn("earlier", F.coalesce("near", "carried")).drop("near", "carried", "span", "full")


def resolve(records: DataFrame, span: int = 1 << 20) -> DataFrame:
    """``record_id``, ``canonical``, ``captured``, ``outcome``, ``refers_to``, ``digest``, ``headers`` of every revisit.

    ``records``: record_id long, url string, captured long, revisit boolean, etag, last_modified and digest strings,
    headers map<string,string> with names in lower case. ``headers`` of the result are those of the response with the
    permitted ones of the revisit over them, null unless resolved.
    """
    own = ["record_id", "url", "captured", "etag", "last_modified", "digest", "headers"]
    rows = records.select(*own, F.coalesce("revisit", F.lit(False)).alias("revisit"), canonical_url(F.col("url")).alias("canonical"))
    known = rows.where("url IS NOT NULL AND captured IS NOT NULL")
    lost = rows.where("(url IS NULL OR captured IS NULL) AND revisit")
    found = as_of(known, span)
    found = found.unionByName(lost, allowMissingColumns=True)
    e = F.col("earlier")
    tags = F.coalesce(_weak(F.col("etag")) == _weak(e["etag"]), F.lit(False))
    dates = F.coalesce(F.col("last_modified") == e["last_modified"], F.lit(False))
    same = F.when(F.col("etag").isNotNull(), tags).when(F.col("last_modified").isNotNull(), dates).otherwise(F.lit(True))
    same = same & F.when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == e["digest"], F.lit(False))).otherwise(F.lit(True))
    outcome = F.when(e.isNull(), "unresolved").when(same, "resolved").otherwise("mismatch")
    newer = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    stored = F.coalesce(e["headers"], F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(newer, k)), newer)
    return found.select(
        "record_id",
        "canonical",
        "captured",
        outcome.alias("outcome"),
        e["record_id"].alias("refers_to"),
        F.when(outcome == "resolved", e["digest"]).alias("digest"),
        F.when(outcome == "resolved", merged).alias("headers"),
    )


def listed(resolved: DataFrame) -> DataFrame:
    """The headers as text, in order of their names, for sinks without maps."""
    names = F.array_sort(F.map_keys("headers"))
    text = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(": "), F.coalesce(F.element_at("headers", n), F.lit("")))), "; ")
    return resolved.withColumn("headers", text)


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """The resolved revisits with the body (``record_id``, ``body``) of the response each refers to."""
    return resolved.join(bodies.select(F.col("record_id").alias("refers_to"), "body"), "refers_to", "left")


def crawl_log(pages: DataFrame) -> DataFrame:
    """Captures that a crawler with conditional requests would have made of the given pages, in four visits.

    The first visit stores the page, except for some pages that it only revisits; the second is a revisit, some with an
    outdated tag; the third stores a new version of every third page; the last revisits all by date or by tag.
    """
    visits = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("hash"), F.explode(F.array(*map(F.lit, range(4)))).alias("visit"))
    p, v = F.col("page_id"), F.col("visit")
    full = ((v == 0) & (p % 7 != 3)) | ((v == 2) & (p % 3 == 0))
    version = F.when((v >= 2) & (p % 3 == 0), 2).otherwise(1)
    tag = F.concat(F.lit('"'), F.substring("hash", 1, 12), F.lit("-"), version.cast("string"), F.lit('"'))
    stale = (v == 1) & (p % 5 == 0)
    etag = F.when((v == 3) & (p % 2 == 0), F.lit(None)).when(stale, F.lit('"old"')).when(v == 3, F.concat(F.lit("W/"), tag)).otherwise(tag)
    modified = F.concat(F.lit("v"), version.cast("string"))
    return visits.select(
        (p * 4 + v).alias("record_id"),
        "url",
        (v.cast("long") * 1_000_000_000 + p).alias("captured"),
        (~full).alias("revisit"),
        etag.alias("etag"),
        modified.alias("last_modified"),
        F.when(full, F.concat("hash", F.lit("-"), version.cast("string"))).alias("digest"),
        F.create_map(
            F.lit("date"), F.concat(F.lit("visit "), v.cast("string")),
            F.lit("content-type"), F.when(full, F.lit("text/html")).otherwise(F.lit("text/plain")),
            F.when(full, F.lit("server")).otherwise(F.lit("expires")), F.concat(F.lit("e"), p.cast("string")),
        ).alias("headers"),
    )


#: The crawl log of the given pages, resolved, in DuckDB: one window over all captures of a URL.
ORACLE = rf"""
WITH bare AS (
  SELECT page_id AS p, md5(coalesce(html, '')) AS hash, url,
    regexp_replace(regexp_replace(regexp_replace(url, '#.*$', '', 'g'),
      '([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', '', 'g') AS b
  FROM pages
),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[A-Za-z]+://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(b, '^[A-Za-z]+://[^/?]*(.*)$', 1), '/+($|\?)', '\1', 'g') AS path
  FROM bare
),
visits AS (
  SELECT p, hash, v, CASE WHEN length(host) > 0 THEN host || path ELSE b END AS canonical,
    (v = 0 AND p % 7 <> 3) OR (v = 2 AND p % 3 = 0) AS stored, CASE WHEN v >= 2 AND p % 3 = 0 THEN 2 ELSE 1 END AS version
  FROM parts, (SELECT unnest([0, 1, 2, 3]) AS v)
),
captures AS (
  SELECT p * 4 + v AS record_id, canonical, CAST(v AS BIGINT) * 1000000000 + p AS captured, p, v, stored, hash || '-' || version AS digest, 'v' || version AS modified,
    CASE WHEN v = 3 AND p % 2 = 0 THEN NULL WHEN v = 1 AND p % 5 = 0 THEN '"old"' ELSE '"' || left(hash, 12) || '-' || version || '"' END AS tag
  FROM visits
),
met AS (
  SELECT *, last_value(CASE WHEN stored THEN {{'id': record_id, 'tag': tag, 'modified': modified, 'digest': digest, 'p': p}} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e
  FROM captures
),
judged AS (
  SELECT *, CASE WHEN e IS NULL THEN 'unresolved'
    WHEN CASE WHEN tag IS NOT NULL THEN coalesce(tag = e.tag, false) ELSE modified = e.modified END THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM met WHERE NOT stored
)
SELECT CAST(record_id AS BIGINT) AS record_id, canonical, CAST(captured AS BIGINT) AS captured, outcome, CAST(e.id AS BIGINT) AS refers_to,
  CASE WHEN outcome = 'resolved' THEN e.digest END AS digest,
  CASE WHEN outcome = 'resolved' THEN 'content-type: text/html; date: visit ' || v || '; expires: e' || p || '; server: e' || e.p END AS headers
FROM judged"""

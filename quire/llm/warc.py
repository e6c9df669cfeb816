"""Resolution of not-modified revisits in web archives.

A revisit record says that its page had not changed; what it stood for is the
latest earlier full response of the same canonical URL, if their validators
agree.  The as-of join runs in two levels, so that one URL with very many
captures spreads over tasks: the last response of each URL and stretch of time
is aggregated first, a running maximum over stretches gives what each begins
with, and only the captures of one stretch are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a stretch.
STRETCH = 3600
# Fields of a not-modified answer that never replace the stored response's (RFC 9110, RFC 9111).
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "proxy-connection", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that do not name another page.
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid|sessionid|sid)(=|$)"


#: SQL of a URL without fragment and scheme.
_BARE = r"regexp_replace(regexp_replace({}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"


def canonical(url: str = "url") -> Column:
    """A URL without scheme, "www.", default port, fragment, tracking parameters, index file and last slash; host in lower case, parameters in order.

    Null for a null or empty URL.
    """
    return F.expr(rf"""
        nullif(concat(
            regexp_replace(regexp_replace(lower(regexp_extract({_BARE.format(url)}, '^[^/?]*', 0)), '^www\\.', ''), ':(80|443)$', ''),
            regexp_replace(regexp_replace(regexp_extract({_BARE.format(url)}, '^[^/?]*([^?]*)', 1), '/index\\.(html|htm|php)$', '/'), '/+$', ''),
            coalesce(concat('?', nullif(array_join(array_sort(filter(split(regexp_extract({_BARE.format(url)}, '^[^?]*\\?(.*)$', 1), '&'),
                p -> p <> '' and not regexp_like(p, '{TRACKING}'))), '&'), '')), '')), '')""")



def resolve(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row for each revisit of ``records``.

    ``records``: record_id long, url string, date long (seconds), type string
    ("response" or "revisit"), etag string, last_modified string, headers
    map<string, string> (names in lower case).  Returns record_id,
    canonical_url, response_id, outcome and headers:

    - ``resolved``: the latest response of that canonical URL with an earlier
      date, whose validators agree: equal entity tags where both have one, else
      equal dates of modification where both have one.  Its fields, replaced by
      the revisit's except for :data:`KEPT_FIELDS`, are ``headers``.
    - ``mismatch``: that response's validators differ (response_id stays).
    - ``unvalidated``: no validator is on both sides (response_id stays).
    - ``missing``: there is no earlier response, or the URL or date is null.

    Of responses of one date the largest record_id counts; a response of the
    revisit's own date is not earlier.  Null headers count as none; records of
    other types and other columns are ignored; repeated revisits each give a row.
    """
    known = records.select("record_id", "url", "date", "type", "etag", "last_modified", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")).withColumn("canonical_url", canonical())
    keys = known.where("type in ('response', 'revisit')").select("record_id", "canonical_url", "date", F.floor(F.col("date") / stretch).alias("stretch"), (F.col("type") == "response").alias("full"))
    timed = keys.where("canonical_url is not null and date is not null")
    mark = F.when(F.col("full"), F.struct("date", "record_id"))
    # stretches with any capture, and the latest response before each
    stretches = timed.groupBy("canonical_url", "stretch").agg(F.max(mark).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select("canonical_url", "stretch", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("canonical_url", "stretch").orderBy("date", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = timed.withColumn("own", F.max(mark).over(within)).where("not full").join(carried, ["canonical_url", "stretch"])
    matched = seen.select("record_id", "date", F.coalesce("own", "carried").getField("record_id").alias("response_id")).distinct()
    revisits = known.where("type = 'revisit'").join(matched, ["record_id", "date"], "left")
    full = known.where("type = 'response'").select(
        F.col("record_id").alias("response_id"), F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"), F.col("headers").alias("r_headers")
    ).dropDuplicates(["response_id"])
    both = revisits.join(full, "response_id", "left")
    fields = ", ".join(f"'{f}'" for f in KEPT_FIELDS)
    merged = F.expr(f"map_concat(map_filter(r_headers, (k, v) -> not map_contains_key(headers, k) or k in ({fields})), map_filter(headers, (k, v) -> k not in ({fields})))")
    outcome = (
        F.when(F.col("response_id").isNull(), "missing")
        .when(F.col("etag").isNotNull() & F.col("r_etag").isNotNull(), F.when(F.col("etag") == F.col("r_etag"), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull() & F.col("r_modified").isNotNull(), F.when(F.col("last_modified") == F.col("r_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    return both.withColumn("outcome", outcome).select("record_id", "canonical_url", "response_id", "outcome", F.when(F.col("outcome") == "resolved", merged).alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """Archive records of a table of pages (page_id, url, html): a full response for each, and an hour later a revisit by a tracking link.

    A page is captured at second 60 * page_id.  The revisit of every seventh
    page carries another entity tag; that of every fifth has none, but the date
    of modification.
    """
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    tag, modified = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')), F.concat(F.lit("day "), F.substring(digest, 17, 2))
    bare = F.regexp_replace("url", "#.*$", "")
    base = pages.select("page_id", "url", tag.alias("tag"), modified.alias("modified"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"), F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&utm_medium=crawl").otherwise("?utm_medium=crawl")).alias("again"))
    of_page = F.col("page_id")
    responses = base.select(
        (2 * of_page).alias("record_id"), "url", (60 * of_page).alias("date"), F.lit("response").alias("type"), F.col("tag").alias("etag"), F.col("modified").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("etag"), F.col("tag")).alias("headers"),
    )
    etag = F.when(of_page % 7 == 0, F.lit('"other"')).when(of_page % 5 != 0, F.col("tag"))
    revisits = base.select(
        (2 * of_page + 1).alias("record_id"), F.col("again").alias("url"), (60 * of_page + 3600).alias("date"), F.lit("revisit").alias("type"), etag.alias("etag"), F.col("modified").alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("x-served-by"), F.concat(F.lit("cache-"), (of_page % 9).cast("string"))).alias("headers"),
    )
    return responses.unionByName(revisits)

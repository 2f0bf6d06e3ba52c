"""Audits the links of a site's pages: which lead nowhere, which pages nothing leads to, and what addresses several pages have.

    python -m jobs.link_audit --pages PATH --out DIR [--config jobs/link_audit.json]

Reads a table of pages (page_id, url, html) and writes

    OUT/links/status=…   every link of every page: ok (a page of the table), broken (on one of its hosts, but no page), external, anchor, other
    OUT/pages/lang=…     for each page its title, links by status, the pages that link to it, whether it is an orphan, pages of the same address

A run replaces both tables, so that it may be repeated. An address is host and path, without scheme, fragment, empty, . and .. segments and
tracking parameters; case is ignored in hosts only. Links are the <a href> outside comments, scripts and styles.

Scale: pages are read once for their links, which are narrow rows; targets are joined by address, where a target that a third of all links
have is split by adaptive execution (an address is one row on the other side); sums are made before they are shuffled.

Defined cases: a null or odd url has no address: such a page is an orphan and its relative links are other; null html has no links; of pages with
one address the least page_id stands for it, and links to it count for all; a page's links to itself aren't backlinks; rows of one
page_id and address are one page with all their links; a null or empty lang is the partition __HIVE_DEFAULT_PARTITION__; further columns are ignored.
Configuration: tracking are patterns of parameters' names that an address drops, own_hosts are hosts that count as the site's though they have no page.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import configured, log, partitioned, started
from sextant.operators import docs
from sextant.operators.markdown import normalized_path

DEFAULTS = {"tracking": ["utm_[a-z]+", "ref"], "own_hosts": []}
LINKS = "page_id long, page string, position int, href string, text string, host string, target string, target_page long, status string"
REPORT = "page_id long, address string, title string, links long, ok long, broken long, external long, backlinks long, orphan boolean, same_address long, lang string"

URL = r"^[Hh][Tt][Tt][Pp][Ss]?://([^/?#]*)([^?#]*)(\?[^#]*)?"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
LINK = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""


def flat(text: Column) -> Column:
    """Without tags, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\s+", " "))


def address_of(url: Column, tracking: list[str]) -> Column:
    """host/path?query of an absolute http url, null for any other text."""
    query = F.regexp_extract(url, URL, 3)
    drop = "^(" + "|".join(tracking) + ")(=|$)" if tracking else "^$"
    kept = F.array_join(F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda x: (x != "") & ~x.rlike(drop)), "&")
    path = F.regexp_replace(normalized_path(F.regexp_extract(url, URL, 2)), r"^(\.\.(/|$))+", "")  # nothing lies above a host
    return F.when(url.rlike(URL), F.concat(F.lower(F.regexp_extract(url, URL, 1)), F.lit("/"), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def absolute(href: Column, url: Column) -> Column:
    """Where a link of the page at url leads; null where it stays on the page or isn't for a reader of pages."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    here = F.regexp_extract(url, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.substring(here, F.length(site) + 1, F.lit(1 << 30)), "[^/]*$", "")
    return (
        F.when(href.rlike("^$|^#"), None).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(site == "", None).when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([^:]*:)", 1), href)).when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(here, href)).otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )


def links_of(pages: DataFrame, tracking: list[str]) -> DataFrame:
    """(page_id, page, position, href, text, host, target): the links as they stand, before they are looked up."""
    seen = F.regexp_replace("html", UNSEEN, "")
    pairs = F.arrays_zip(F.regexp_extract_all(seen, F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all(seen, F.lit(LINK), F.lit(2)).alias("text"))
    rows = pages.select("page_id", "url", address_of(F.col("url"), tracking).alias("page"), F.posexplode(pairs).alias("position", "link"))
    rows = rows.withColumn("href", F.trim(F.replace("link.href", F.lit("&amp;"), F.lit("&"))))
    to = absolute(F.col("href"), F.coalesce("url", F.lit("")))
    rows = rows.withColumn("to", to).withColumn("target", address_of(F.col("to"), tracking))
    return rows.select("page_id", "page", F.col("position").cast("int"), "href", flat(F.col("link.text")).alias("text"), F.substring_index("target", "/", 1).alias("host"), "target")


def run(spark: SparkSession, pages: str, out: str, config: dict | None = None) -> DataFrame:
    """Writes both tables and returns the report by page, read back."""
    config = DEFAULTS | (config or {})
    table = spark.read.parquet(pages).select("page_id", "url", "html")
    known = table.select("page_id", address_of(F.col("url"), config["tracking"]).alias("address")).distinct()
    at = known.filter("address is not null").groupBy("address").agg(F.min("page_id").alias("target_page"), F.count("*").alias("same_address"))
    hosts = at.select(F.substring_index("address", "/", 1).alias("host")).union(spark.createDataFrame([(h.lower(),) for h in config["own_hosts"]], "host string")).distinct()

    found = links_of(table, config["tracking"]).join(at.select(F.col("address").alias("target"), "target_page"), "target", "left").join(hosts.withColumn("own", F.lit(True)), "host", "left")
    status = (
        F.when(F.col("target").isNull(), F.when(F.col("href").rlike("^$|^#"), "anchor").otherwise("other"))
        .when(F.col("target_page").isNotNull(), "ok").when(F.col("own"), "broken").otherwise("external")
    )
    partitioned(found.select("page_id", "page", "position", "href", "text", "host", "target", "target_page", status.alias("status")), f"{out}/links", "status")

    links = spark.read.schema(LINKS).parquet(f"{out}/links")
    n = {s: F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("ok", "broken", "external")}
    per = links.groupBy(F.col("page_id").alias("_id"), F.col("page").alias("_page")).agg(F.count("*").alias("links"), *n.values())
    from_others = links.filter("status = 'ok' and (page is null or page <> target)").select(F.col("page").alias("source_file"), F.col("target").alias("target_resolved")).distinct()
    into = from_others.groupBy(F.col("target_resolved").alias("address")).agg(F.count("*").alias("backlinks"))
    lost = docs.orphans(at.select(F.col("address").alias("file_path")), from_others).select(F.col("file_path").alias("address"), F.lit(True).alias("lost"))
    lang, title = F.regexp_extract("html", r"""(?is)<html[^>]*\slang=["']([^"']*)["']""", 1), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    report = table.groupBy("page_id", address_of(F.col("url"), config["tracking"]).alias("address")).agg(F.coalesce(F.max(flat(title)), F.lit("")).alias("title"), F.max(F.nullif(lang, F.lit(""))).alias("lang"))
    report = report.join(per, report["page_id"].eqNullSafe(per["_id"]) & report["address"].eqNullSafe(per["_page"]), "left").drop("_id", "_page")
    report = report.join(into, "address", "left").join(lost, "address", "left").join(at.select("address", "same_address"), "address", "left")
    report = report.fillna(0, ["links", "ok", "broken", "external", "backlinks"]).fillna(1, ["same_address"]).withColumn("orphan", F.col("lost").isNotNull() | F.col("address").isNull())
    partitioned(report.select("page_id", "address", "title", "links", "ok", "broken", "external", "backlinks", "orphan", "same_address", "lang"), f"{out}/pages", "lang")

    done = spark.read.schema(REPORT).parquet(f"{out}/pages")
    said = done.agg(F.count("*").alias("pages"), F.sum("links").alias("links"), F.sum("broken").alias("broken"), F.count(F.when(F.col("orphan"), 1)).alias("orphans")).first()
    log.info("read %d pages of %s with %d links: %d broken, %d orphans", said.pages, pages, said.links or 0, said.broken or 0, said.orphans)
    return done


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="link-audit", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--pages", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config")
    args, spark = started(p, argv)
    try:
        run(spark, args.pages, args.out, configured(spark, args.config, DEFAULTS))
    finally:
        spark.stop()
    return 0


def _sql_address(url: str) -> str:
    path = rf"list_reduce(list_prepend('', string_split(regexp_extract({url}, '{URL}', 2), '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN x ELSE a || '/' || x END)"
    query = rf"array_to_string(list_filter(string_split(regexp_extract({url}, '{URL}', 3)[2:], '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)')), '&')"
    return f"CASE WHEN regexp_matches({url}, '{URL}') THEN lower(regexp_extract({url}, '{URL}', 1)) || '/' || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


#: The report in SQL, for the default configuration.
SQL = rf"""WITH t AS (SELECT page_id, coalesce(url, '') AS url, html, {_sql_address('url')} AS address FROM pages),
 k AS (SELECT DISTINCT page_id, address FROM t WHERE address IS NOT NULL),
 adr AS (SELECT address, min(page_id) AS target_page, count(*) AS same_address FROM k GROUP BY 1),
 hosts AS (SELECT DISTINCT split_part(address, '/', 1) AS host FROM adr),
 s AS (SELECT page_id, url, address, regexp_replace(html, '{UNSEEN}', '', 'g') AS seen FROM t),
 e AS (SELECT page_id, url, address, trim(replace(unnest(regexp_extract_all(seen, '{LINK.replace("'", "''")}', 1)), '&amp;', '&'), ' ') AS href FROM s),
 u AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, regexp_extract(url, '^([^?#]*)', 1) AS here FROM e),
 f AS (SELECT *, regexp_replace(here[length(site) + 1:], '[^/]*$', '') AS folder FROM u),
 l AS (SELECT *, CASE WHEN regexp_matches(href, '^$|^#') THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR site = '' THEN NULL
   WHEN starts_with(href, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || href WHEN starts_with(href, '/') THEN site || href WHEN starts_with(href, '?') THEN here || href ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS goes FROM f),
 g AS (SELECT page_id, address, {_sql_address('goes')} AS target FROM l),
 x AS (SELECT g.*, CASE WHEN target IS NULL THEN 'none' WHEN adr.address IS NOT NULL THEN 'ok' WHEN hosts.host IS NOT NULL THEN 'broken' ELSE 'external' END AS status FROM g LEFT JOIN adr ON adr.address = g.target LEFT JOIN hosts ON hosts.host = split_part(g.target, '/', 1)),
 n AS (SELECT page_id, address, count(*) AS links, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'broken') AS broken, count(*) FILTER (WHERE status = 'external') AS external FROM x GROUP BY ALL),
 b AS (SELECT target AS address, count(*) AS backlinks FROM (SELECT DISTINCT address AS a, target FROM x WHERE status = 'ok' AND address IS DISTINCT FROM target) GROUP BY 1),
 r AS (SELECT page_id, address, coalesce(max(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ')), '') AS title, max(nullif(regexp_extract(html, '(?is)<html[^>]*\slang=["'']([^"'']*)["'']', 1), '')) AS lang FROM t GROUP BY 1, 2)
 SELECT r.page_id, r.address, r.title, coalesce(links, 0) AS links, coalesce(ok, 0) AS ok, coalesce(broken, 0) AS broken, coalesce(external, 0) AS external, coalesce(backlinks, 0) AS backlinks, coalesce(backlinks, 0) = 0 AS orphan, coalesce(same_address, 1) AS same_address, r.lang
 FROM r LEFT JOIN n ON n.page_id IS NOT DISTINCT FROM r.page_id AND n.address IS NOT DISTINCT FROM r.address LEFT JOIN b ON b.address = r.address LEFT JOIN adr ON adr.address = r.address"""


if __name__ == "__main__":
    raise SystemExit(main())

"""Queries over web pages: links, addresses, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import evidence


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, anchor) in document order."""
    pair = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("anchor"))
    return pages.select("page_id", "url", F.posexplode(pair).alias("pos", "a")).select("page_id", "url", "pos", F.col("a.href").alias("href"), F.col("a.anchor").alias("anchor"))


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of pages as the HTML parser reads them."""
    pages = evidence.typed(read(spark, sf_dir, "pages").select("page_id", "url", F.lit("text/html").alias("content_type"), F.col("html").cast("binary").alias("payload")))
    return pages.select("page_id", F.posexplode("page.links").alias("pos", "l")).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("l.url").alias("href"), F.col("l.text").alias("anchor"))


_SQL_ANCHORS = r"""
anchors AS (
  SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS anchor
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages))"""

#: Stated anew, not taken from the functions, which these queries check.
_KEYS = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'mc_cid', 'mc_eid', 'width', 'height', 'format', 'quality', 'fit', 'crop', 'dpr', 'v'"


def _sql_canonical(u: str) -> str:
    host = rf"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    scheme = rf"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    path = rf"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    kept = rf"list_filter(str_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda kv: kv <> '' AND lower(regexp_extract(kv, '^([^=]*)', 1)) NOT IN ({_KEYS}))"
    query = f"array_to_string(list_transform({kept}, lambda kv: CASE WHEN contains(kv, '=') THEN kv ELSE kv || '=' END), '&')"
    return f"CASE WHEN {scheme} IN ('http', 'https') AND {host} <> '' THEN {scheme} || '://' || lower({host}) || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END ELSE '' END"


def with_keys(url):
    """Page addresses with further query keys, of which some name another document and some do not."""
    k = F.col("page_id")
    more = F.concat(F.lit("UTM_Campaign=a&ref="), (k % 7).cast("string"), F.lit("&crop=1&q="), (k % 5).cast("string"), F.lit("&w=3&mc_eid=x&gclid&v=2&dpr="), k.cast("string"))
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(k % 3 == 0, url).otherwise(F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), more))


_SQL_KEYS = r"""CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(url, '#.*$', '') || CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN '&' ELSE '?' END
  || 'UTM_Campaign=a&ref=' || page_id % 7 || '&crop=1&q=' || page_id % 5 || '&w=3&mc_eid=x&gclid&v=2&dpr=' || page_id END"""


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = with_keys(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical(u).alias("canonical"), urls.host(u).alias("host"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = anchors(read(spark, sf_dir, "pages"))
    return a.withColumn("target", urls.canonical(urls.resolve(F.col("url"), F.col("href")))).filter("target <> ''")


def url_resolve_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link to each target of a page."""
    w = Window.partitionBy("page_id", "target").orderBy("pos")
    return resolved(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n = 1").select("page_id", F.col("pos").cast("long").alias("pos"), "target", "anchor")


_SQL_RESOLVED = rf"""{_SQL_ANCHORS},
absolute AS (
  SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
    WHEN starts_with(href, '//') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || ':' || href
    WHEN starts_with(href, '/') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || href
    ELSE '' END AS full_url FROM anchors),
resolved AS (SELECT page_id, pos, anchor, {_sql_canonical("full_url")} AS target FROM absolute)"""


def _link_class(target, anchor):
    t = F.lower(F.concat_ws(" ", F.regexp_extract(urls.path(target), "([^/]*)$", 1), anchor))
    return F.when(t.rlike("floor ?plan"), "floorplan").when(t.rlike("brochure"), "brochure").when(t.rlike("logo|icon"), "logo").when(t.rlike("^th|tion"), "section").when(t.rlike("[^a-z /.]"), "foreign").otherwise("link")


_SQL_CLASS = r"""CASE WHEN regexp_matches(t, 'floor ?plan') THEN 'floorplan' WHEN regexp_matches(t, 'brochure') THEN 'brochure'
  WHEN regexp_matches(t, 'logo|icon') THEN 'logo' WHEN regexp_matches(t, '^th|tion') THEN 'section' WHEN regexp_matches(t, '[^a-z /.]') THEN 'foreign' ELSE 'link' END"""
_SQL_TEXT = r"lower(regexp_extract(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) || ' ' || anchor)"


#: What is put behind a link's target in asset_classes, by its place (fixed values).
ASSET_NAMES = ["", "/x.jpg", "/floor-plan.png", "/media/y", "/brand-logo.webp", "/z.pdf", "/brochure.pdf", "/city-map.gif", "/assets/office.jpeg", "/og-image.png", "/pixel.gif", "/brochure.jpg"]


def asset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as assets, with sides, occurrences and association from their place."""
    d = resolved(spark, sf_dir).withColumn("u", F.concat("target", F.element_at(F.array(*[F.lit(x) for x in ASSET_NAMES]), (F.col("pos") + F.col("page_id")).cast("int") % len(ASSET_NAMES) + 1)))
    k = F.col("page_id") + F.col("pos")
    side = F.when(k % 7 == 0, 6).when(k % 7 == 1, 250).when(k % 7 == 2, 900)
    return d.select("page_id", "pos", "u", "anchor", side.alias("width"), F.when(side.isNotNull(), 400).alias("height"), (k % 3 + 1).alias("seen"), (0.5 + (k % 4) / 10).alias("near"))


def asset_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = urls.asset_class(F.col("u"), F.col("anchor"), F.lit(""), F.col("width"), F.col("height"), F.col("seen"), F.col("near"))
    links = asset_candidates(spark, sf_dir).withColumn("c", c)
    return links.groupBy("c.class", "c.confidence").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per page and class, each target once, and the classes rendered as `class=count`."""
    links = url_resolve_dedupe(spark, sf_dir).withColumn("class", _link_class(F.col("target"), F.col("anchor")))
    counts = links.groupBy("page_id", "class").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("class", "n"))), lambda s: F.concat(s["class"], F.lit("="), s["n"].cast("string")))
    return counts.groupBy("page_id").agg(F.sum("n").alias("links"), F.array_join(parts, ",").alias("classes"))


QUERIES = {"page_items": page_items, "url_canonical": url_canonical, "url_resolve_dedupe": url_resolve_dedupe, "asset_classes": asset_classes, "page_links": page_links}
SQL = {
    "page_items": f"WITH {_SQL_ANCHORS} SELECT page_id, pos, href, anchor FROM anchors",
    "url_canonical": f"WITH u AS (SELECT page_id, {_SQL_KEYS} AS u FROM pages) SELECT page_id, {_sql_canonical('u')} AS canonical, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM u",
    "url_resolve_dedupe": f"WITH {_SQL_RESOLVED} SELECT page_id, min(pos) AS pos, target, arg_min(anchor, pos) AS anchor FROM resolved WHERE target <> '' GROUP BY page_id, target",
    "asset_classes": rf"""WITH {_SQL_RESOLVED},
a AS (SELECT page_id, anchor, page_id + pos AS k, target || ['', '/x.jpg', '/floor-plan.png', '/media/y', '/brand-logo.webp', '/z.pdf', '/brochure.pdf', '/city-map.gif', '/assets/office.jpeg', '/og-image.png', '/pixel.gif', '/brochure.jpg'][(page_id + pos) % 12 + 1] AS u FROM resolved WHERE target <> ''),
b AS (SELECT *, CASE k % 7 WHEN 0 THEN 6 WHEN 1 THEN 250 WHEN 2 THEN 900 END AS w, k % 3 + 1 AS seen, k % 4 AS near, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM a),
c AS (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS f FROM b),
d AS (SELECT *, lower(f || ' ' || anchor) AS t, regexp_matches(lower(f), '\.(jpg|jpeg|png|webp|gif)$') AS img, regexp_matches(lower(p), '/assets?/|/media/|/digitalassets?/|/static/(img|images|media)/|/img/|/photos?/|/gallery/') AS place FROM c),
e AS (SELECT *, regexp_matches(t, 'reception|office|workspace|interior|exterior|terrace|meeting|boardroom|breakout|kitchen|building|facade|fa.ade|gallery|hero|desk|lounge|property') AS prop FROM d),
g AS (SELECT page_id, CASE WHEN w <= 8 THEN ('tracking', 1.0) WHEN regexp_matches(t, 'pixel|tracking|spacer|social|icon|divider|transparent') THEN ('decorative', 0.98)
  WHEN regexp_matches(t, 'logo|brandmark|signature|avatar|headshot') THEN ('logo', 0.98) WHEN regexp_matches(t, 'preview|thumbnail|thumb|document[-_ ]?(cover|page)|og[-_ ]?image') THEN ('preview', 0.94)
  WHEN regexp_matches(t, 'map|location[\s_-]*plan|streetview') THEN ('map', 0.92) WHEN regexp_matches(t, 'floor[\s_-]*plan|layout') THEN ('floorplan', 0.95)
  WHEN NOT img AND regexp_matches(t, 'brochure|particulars|marketing[\s_-]*details|download\s*(pdf|details|document)') THEN ('brochure', 0.95) WHEN regexp_matches(lower(f), '\.(pdf|doc|docx)$') THEN ('unknown', 0.2)
  WHEN NOT img AND NOT place THEN ('unknown', 0.0) WHEN seen > 1 AND near < 3 AND NOT prop THEN ('decorative', 0.9) WHEN w < 320 THEN ('decorative', 0.86) WHEN prop OR near = 3 THEN ('photo', 0.82)
  WHEN near >= 1 AND place THEN ('photo', 0.75) ELSE ('unknown', 0.25) END AS c FROM e)
SELECT c[1] AS class, c[2]::DOUBLE AS confidence, count(*) AS links, count(DISTINCT page_id) AS pages FROM g GROUP BY ALL""",
    "page_links": f"""WITH {_SQL_RESOLVED}, f AS (SELECT page_id, target, arg_min(anchor, pos) AS anchor FROM resolved WHERE target <> '' GROUP BY page_id, target),
c AS (SELECT *, {_SQL_TEXT} AS t FROM f), n AS (SELECT page_id, {_SQL_CLASS} AS class, count(*) AS n FROM c GROUP BY ALL)
SELECT page_id, sum(n)::BIGINT AS links, string_agg(class || '=' || n, ',' ORDER BY class) AS classes FROM n GROUP BY page_id""",
}

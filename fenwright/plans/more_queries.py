"""Further operators over the same tables: text fields, addresses, places on pages, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address, dates, merge, numbers, text, urls
from ..operators import matching
from ..streaming import lookups
from .page_queries import read
from .table_queries import TIME, USER, boxes, is_


def answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").withColumn("found", is_("purchase"))
    return lookups.answer_states_batch(log, "user_id", TIME)


def heading_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every box the nearest one above it on the page of its label."""
    b = boxes(spark, sf_dir)
    images = b.select("label", F.col("vec_id").alias("image_id"), "box")
    headings = b.select("label", F.col("vec_id").alias("heading_id"), F.col("box").alias("head"))
    return matching.nearest_above(images, headings, ["label"]).select("image_id", "heading_id")


def page_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer dealt over the months in which it has orders, twice in months with several."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.month("o_orderdate").alias("page"))
    slots = o.groupBy("o_custkey", "page").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("n"))
    got = matching.spread(o.drop("page"), slots, "o_custkey", "o_orderkey", "n")
    return got.select("o_orderkey", F.col("page").cast("long").alias("page"))


def item_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*TIME))
    e = e.withColumn("place", place)
    segments = e.select("user_id", F.col("place").cast("long").alias("segment_no"), F.col("event_id").alias("item"))
    return matching.zip_islands(e.select("user_id", "event_id", "event_type", "place"), "event_type", segments, USER, "place").select("event_id", "segment_no", "item")


def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name, number = F.concat(F.initcap("c_mktsegment"), F.lit(" House")), k % 90 + 10
    code = F.concat(F.lit("EC"), (k % 4 + 1).cast("string"), F.lit("A 1BB"))
    other = F.concat(F.lit("EC"), (k % 3 + 1).cast("string"), F.lit("A 1BB"))
    there = F.when(k % 11 == 0, number + 1).otherwise(number)
    page = F.concat_ws("\n", F.when(k % 2 == 0, name).otherwise(F.lit("Some House")), F.when(k % 5 != 0, F.concat(F.lit("at "), there.cast("string"), F.lit("  Market St"))), F.when(k % 7 != 0, other))
    return read(spark, sf_dir, "customer").select("c_custkey", merge.identity(name, F.concat(number.cast("string"), F.lit(" Market Street")), code, page, F.when(k % 3 == 0, 0.9)).alias("decision"))


def address_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's composed address against a candidate that differs in number, range, street, name, locality or postcode."""
    k = F.col("c_custkey")
    want = F.concat(F.lit("Unit House, "), (k % 9 + 1).cast("string"), F.lit(" Market St, London EC1A 1BB"))
    number = F.when(k % 5 == 0, F.concat((k % 7 + 1).cast("string"), F.lit("-"), (k % 7 + 4).cast("string"))).when(k % 11 == 0, F.lit("")).otherwise((k % 7 + 1).cast("string"))
    got = F.concat(F.when(k % 2 == 0, F.lit("Unit House, ")).otherwise(F.lit("")), number, F.when(k % 4 == 0, F.lit(" Mill Road")).otherwise(F.lit(" Market Street")), F.when(k % 6 == 0, F.lit(", Camden, ")).otherwise(F.lit(", London, ")), F.when(k % 3 == 0, F.lit("EC1A 1BB")).otherwise(F.lit("W1A 2AA")))
    s = address.assess(address.parse_address(want), address.parse_address(got))
    return read(spark, sf_dir, "customer").select("c_custkey", s.alias("s")).select("c_custkey", F.col("s.score").cast("long").alias("score"), "s.rejected", "s.reason")


def source_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of composed sources: by header, then by metadata, then by the five shapes that a file name may have."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    fmt = lambda f: F.date_format(d, f)
    header = F.when(k % 4 == 0, F.concat(F.lit("Mon, "), fmt("d MMM yyyy"), F.lit(" 23:30:00 -0500"))).when(k % 4 == 1, F.lit("not a date"))
    metadata = F.when(k % 6 == 1, F.concat(F.lit("D:"), fmt("yyyyMMdd"), F.lit("120000"))).otherwise("")
    shapes = [F.concat(F.lit("list_"), fmt("dd_MM_yyyy"), F.lit(".eml")), F.concat(F.lit("as of "), fmt("d"), F.lit("th "), fmt("MMMM"), F.lit(".pdf")), F.concat(F.lit("x "), fmt("yyyy-MM-dd"), F.lit(" y.pdf")), F.concat(fmt("d MMM yyyy"), F.lit(" list.xlsx")), F.concat(F.lit("Schedule "), fmt("MMMM yyyy"), F.lit(".csv")), F.lit("31_02_2020.eml"), F.lit("list.eml")]
    name = F.element_at(F.array(*shapes), (k % 7 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.source_date(header, metadata, name, F.year(d), F.lit("2000-01-01").cast("date")).alias("day"))


def join_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of a brand's parts, each once, in the order in which they first occur."""
    first = read(spark, sf_dir, "part").groupBy("p_brand", F.lower("p_type").alias("t")).agg(F.min_by("p_type", "p_partkey").alias("p_type"), F.min("p_partkey").alias("k"))
    g = first.groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p_type"))), lambda s: s["p_type"]).alias("types"))
    return g.select("p_brand", text.join_distinct(F.col("types")).alias("types"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = matching.reading_order(boxes(spark, sf_dir), ["label"], F.col("box.x0"), F.col("box.y0"), "vec_id")
    return d.select("vec_id", F.col("place").cast("long").alias("place"))


def lease_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.element_at(F.array(*[F.lit(s) for s in TERMS]), (k % len(TERMS) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", text.min_term(line).alias("term"), numbers.desks(line).cast("long").alias("desks"))


#: Lines of lease_terms (fixed values).
TERMS = ["12 months", "Minimum 1 yr", "rolling", "10-12 desks", "see website", "Copyright 2025, 24 months", "Flexible or 36 Months", "negotiable", "2 YRS", "terms of use"]


#: Hosts and paths that stand for a page's own in url_flags, by its id (fixed values).
FLAG_PLACES = [
    "", "https://drive.google.com/file/d/A-1_b/view", "https://app.box.com/s/ab12?x=1", "https://www.dropbox.com/s/x/y.doc?dl=0", "http://10.1.2.3/a.pdf", "http://100.64.9.9/x", "https://[fe80::1]/a", "https://224.0.0.9:80/z", "http://8.8.8.8/media/x",
    "https://www.canva.com/design/1", "https://x.list-manage.com/track?u=1", "https://a.example/p/Floor-Plan/view", "https://a.example/p/floorplan.PNG?v=1", "https://a.example/gallery.html", "ftp://a.example/x.pdf", "http://printer.local/x",
]


def url_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.element_at(F.array(*[F.lit(x) for x in FLAG_PLACES]), (F.col("page_id") % len(FLAG_PLACES) + 1).cast("int"))
    u = F.when(given == "", F.col("url")).otherwise(given)
    flags = {"public": urls.is_public, "image": urls.is_image_like, "document": urls.is_document_like, "hosted": urls.is_hosted_document, "plan_page": urls.is_plan_page, "viewer": urls.is_viewer, "seed": urls.is_document_seed, "low_trust": urls.is_low_trust, "direct": urls.direct_document}
    kind = urls.resource_type(F.when(F.col("page_id") % 3 == 0, F.lit("%PDF-1").cast("binary")).otherwise(F.col("html").cast("binary")), F.when(F.col("page_id") % 2 == 0, F.lit("text/html")).otherwise(F.lit("")))
    d = read(spark, sf_dir, "pages").select("page_id", "html", u.alias("u"))
    return d.select("page_id", *[f(F.col("u")).alias(k) for k, f in flags.items()], urls.document_rank(F.col("u")).cast("long").alias("rank"), urls.direct_download(F.col("u")).alias("download"), kind.alias("type"))


def list_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a document kept while their words stay within 100 in all, twelve at most."""
    kept = text.kept_items(F.regexp_replace("text", "\\s+", " "), sep=r"\.")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("kept"), F.md5(F.array_join(kept, "|")).alias("kept_md5"))


QUERIES = {f.__name__: f for f in (answer_states, heading_above, page_occurrences, item_islands, identity_gate, address_scores, source_dates, join_distinct, reading_order, lease_terms, url_flags, list_cap)}

_BOX = "b AS (SELECT vec_id, label, least(embedding[1], embedding[2])::DOUBLE * 100 AS x0, greatest(embedding[1], embedding[2])::DOUBLE * 100 AS x1, least(embedding[3], embedding[4])::DOUBLE * 100 AS y0, greatest(embedding[3], embedding[4])::DOUBLE * 100 AS y1 FROM embeddings)"
SQL = {
    "answer_states": """WITH m AS (SELECT user_id, event_type = 'purchase' AS found, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM events),
g AS (SELECT user_id, min(m) FILTER (found AND m < 3) AS ok, least(max(m), 3) AS n FROM m GROUP BY user_id)
SELECT user_id, CASE WHEN ok IS NOT NULL THEN 'found' WHEN n >= 3 THEN 'final' ELSE 'flaky' END AS status, coalesce(ok, n)::INTEGER AS misses FROM g""",
    "heading_above": f"""WITH {_BOX}, p AS (SELECT i.vec_id AS image_id, h.vec_id AS heading_id, row_number() OVER (PARTITION BY i.vec_id ORDER BY h.y1 DESC, h.vec_id DESC) AS k FROM b i JOIN b h USING (label)
  WHERE h.y1 <= i.y0 AND h.x0 < i.x1 AND h.x1 > i.x0)
SELECT b.vec_id AS image_id, p.heading_id FROM b LEFT JOIN p ON p.image_id = b.vec_id AND p.k = 1""",
    "page_occurrences": """WITH o AS (SELECT o_orderkey, o_custkey, month(o_orderdate) AS page FROM orders), s AS (SELECT o_custkey, page, unnest(range(least(count(*), 2))) AS i FROM o GROUP BY o_custkey, page),
k AS (SELECT o_custkey, page, row_number() OVER (PARTITION BY o_custkey ORDER BY page, i) AS k FROM s), r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM o)
SELECT o_orderkey, page FROM r LEFT JOIN k USING (o_custkey, k)""",
    "item_islands": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events), l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY place) AS b FROM e),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS segment_no FROM l)
SELECT s.event_id, s.segment_no, i.event_id AS item FROM s LEFT JOIN e i ON i.user_id = s.user_id AND i.place = s.segment_no""",
    "identity_gate": """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 4 <> c_custkey % 3 OR c_custkey % 5 <> 0 AND c_custkey % 11 = 0 THEN 'HARD_CONFLICT' WHEN c_custkey % 5 <> 0 OR c_custkey % 7 <> 0 THEN 'MATCH'
  WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'PROBABLE_MATCH' ELSE 'AMBIGUOUS' END AS decision FROM customer""",
    "address_scores": """WITH d AS (SELECT c_custkey AS k, c_custkey % 9 + 1 AS want, c_custkey % 7 + 1 AS low, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 7 + 4 ELSE c_custkey % 7 + 1 END AS high, c_custkey % 5 <> 0 AND c_custkey % 11 = 0 AS bare FROM customer),
r AS (SELECT *, CASE WHEN bare THEN 'number missing' WHEN want NOT BETWEEN low AND high THEN 'number differs' WHEN k % 4 = 0 THEN 'street differs' ELSE '' END AS reason FROM d)
SELECT k AS c_custkey, (CASE WHEN reason <> '' THEN 0 ELSE 85 + CASE WHEN k % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN k % 6 <> 0 THEN 4 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 10 ELSE -5 END END)::BIGINT AS score, reason <> '' AS rejected, reason FROM r""",
    "source_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 6 = 1 OR o_orderkey % 7 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 7 = 4 THEN strftime(o_orderdate, '%Y-%m-01') ELSE '2000-01-01' END AS day FROM orders""",
    "join_distinct": "WITH f AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) AS k, p_partkey FROM part) SELECT p_brand, string_agg(p_type, ', ' ORDER BY p_partkey) AS types FROM f WHERE k = 1 GROUP BY p_brand",
    "reading_order": f"WITH {_BOX} SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY round_even(y0 / 10, 0), x0, vec_id) AS place FROM b",
    "lease_terms": "SELECT p_partkey, ['12 months', '1 year', 'Rolling', '', '', '', 'Flexible', '', '2 years', ''][p_partkey % 10 + 1] AS term, [12, 1, NULL, 12, NULL, 2025, 36, NULL, 2, NULL][p_partkey % 10 + 1]::BIGINT AS desks FROM part",
    "url_flags": r"""WITH g AS (SELECT page_id, url, page_id % 16 AS k FROM pages),
f(k, u, public, image, document, hosted, plan_page, viewer, seed, low_trust, direct, rank, download) AS (VALUES
  (1, '', true, false, false, true, false, true, true, false, false, 2, 'https://drive.usercontent.google.com/download?id=A-1_b&export=download'), (2, '', true, false, false, true, false, true, true, true, false, 2, 'https://app.box.com/shared/static/ab12.pdf'),
  (3, '', true, false, true, true, false, true, true, false, false, 2, 'https://www.dropbox.com/s/x/y.doc?dl=1'), (4, 'http://10.1.2.3/a.pdf', false, false, true, false, false, true, true, false, true, 3, ''), (5, 'http://100.64.9.9/x', false, false, false, false, false, false, true, false, false, 1, ''),
  (6, 'https://[fe80::1]/a', false, false, false, false, false, false, true, false, false, 1, ''), (7, 'https://224.0.0.9:80/z', true, false, false, false, false, false, true, false, false, 1, ''), (8, 'http://8.8.8.8/media/x', true, true, false, false, false, false, false, false, false, 1, ''),
  (9, 'https://www.canva.com/design/1', true, false, false, false, false, true, true, true, false, 0, ''), (10, 'https://x.list-manage.com/track?u=1', true, false, false, true, false, true, true, false, false, 1, ''), (11, 'https://a.example/p/Floor-Plan/view', true, false, false, false, true, true, true, false, false, 1, ''),
  (12, 'https://a.example/p/floorplan.PNG?v=1', true, true, false, false, false, false, false, false, false, 1, ''), (13, 'https://a.example/gallery.html', true, false, false, false, false, false, true, false, false, 1, ''), (14, 'ftp://a.example/x.pdf', true, false, true, false, false, true, true, false, false, 0, ''), (15, 'http://printer.local/x', false, false, false, false, false, false, true, false, false, 1, ''))
SELECT page_id, coalesce(public, true) AS public, coalesce(image, false) AS image, coalesce(document, false) AS document, coalesce(hosted, false) AS hosted, coalesce(plan_page, false) AS plan_page, coalesce(viewer, false) AS viewer, coalesce(seed, true) AS seed, coalesce(low_trust, false) AS low_trust, coalesce(direct, false) AS direct,
  coalesce(rank, 1)::BIGINT AS rank, CASE WHEN f.k IS NULL THEN url WHEN download <> '' THEN download ELSE u END AS download, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 2 = 0 THEN 'html' ELSE 'unknown' END AS type FROM g LEFT JOIN f USING (k)""",
    "list_cap": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(str_split(regexp_replace(text, '\s+', ' ', 'g'), '.'), lambda x: trim(regexp_replace(x, '[ \t\n\x0B\f\r\x{00A0}]+', ' ', 'g'))), lambda x: x <> '') AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM s), c AS (SELECT *, sum(len(str_split(x, ' '))) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM u),
k AS (SELECT doc_id, x, i FROM c WHERE n <= 100 AND i < 12)
SELECT d.doc_id, count(k.x) AS kept, md5(coalesce(string_agg(k.x, '|' ORDER BY k.i), '')) AS kept_md5 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
}

"""Queries over events and trade tables: joins, groups, merges, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address, merge, numbers, text
from ..operators import groups, matching, sequence
from .page_queries import read

USER, TIME = ["user_id"], ["ts", "event_id"]


def is_(kind: str):
    return F.col("event_type") == kind


def link_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in segments that begin at a view."""
    e = sequence.islands(read(spark, sf_dir, "events"), is_("view"), "segment", USER, TIME)
    return e.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = matching.as_of_backward(read(spark, sf_dir, "events"), is_("view"), F.col("event_id"), "view_id", USER, TIME)
    return e.filter(is_("click")).select("event_id", "view_id")


def asof_forward_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = matching.as_of_forward(read(spark, sf_dir, "events"), is_("purchase"), is_("click"), F.col("event_id"), "purchase_id", USER, TIME)
    return e.filter(is_("click")).select("event_id", "purchase_id")


def nearest_within_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = matching.nearest_within(read(spark, sf_dir, "events"), is_("signup"), F.col("event_id"), "signup_id", USER, TIME, 6)
    return e.filter(is_("error")).select("event_id", "signup_id")


def rate_limit_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sequence.call_rate(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 60)
    return e.select("event_id", "in_window", "gap_us", (F.col("in_window") <= 5).alias("allowed"))


def range_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within blocks of event ids of their user: a block runs from each purchase to 40 ids on."""
    e = read(spark, sf_dir, "events")
    blocks = e.filter(is_("purchase")).select("user_id", F.col("event_id").alias("begin"), (F.col("event_id") + 400).alias("end"))
    hits = matching.range_join(e.select("user_id", "event_id"), blocks, ["user_id"], "event_id", "begin", "end", 1000)
    return hits.groupBy("user_id", "begin").agg(F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("last_event"))


def price_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("l_linenumber") % 2 == 1
    pair = numbers.price_pair(F.col("l_quantity"), F.when(odd, F.col("l_extendedprice")), F.when(~odd, numbers.cents(F.col("l_extendedprice") / 100)))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pair.alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.pcm", "p.psf")


def _composed(c: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    code = F.concat(F.lit("EC"), (k % 4 + 1).cast("string"), F.lit("A "), (k % 9 + 1).cast("string"), F.lit("AB"))
    whole = F.concat(F.lit("Unit House, "), (k % 90 + 10).cast("string"), F.lit(" Market St, London "), F.lower(code))
    return c.select("c_custkey", whole.alias("address"))


def postcode_address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _composed(read(spark, sf_dir, "customer")).withColumn("p", address.parse_address(F.col("address")))
    return d.select("c_custkey", "p.number", "p.name", "p.street", "p.locality", "p.postcode", address.street_only(F.col("address")).alias("street_only"))


def area_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(groups.consensus(F.col("o_orderpriority")).alias("priority"), F.count(F.lit(1)).alias("orders"))


def richest_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(groups.richest(F.col("p_name"), F.col("p_partkey")).alias("name"))


def donor_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under 50,000 take the status of their customer's dearest order."""
    d = groups.donor(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"], [F.col("o_totalprice")], "o_orderkey")
    low = F.col("o_totalprice") < 50_000
    return d.select("o_orderkey", F.when(low, F.col("donor.o_orderkey")).alias("donor_order"), F.when(low, F.col("donor.o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status"))


def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates for a customer's address, ranked; the best three. Another number or street rejects a candidate, so only those with the
    same ones, in the same nation, are met at all."""
    parsed = lambda k, balance: F.struct((k % 10 + 1).cast("string").alias("number"), F.when(balance > 5000, F.lit("unit house")).otherwise("").alias("name"), F.concat(F.lit("street "), (k % 3).cast("string")).alias("street"), F.lit("london").alias("locality"), F.concat(F.lit("EC1A "), (k % 4 + 1).cast("string"), F.lit("AA")).alias("postcode"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), parsed(F.col("c_custkey"), F.col("c_acctbal")).alias("w")).withColumns({"number": F.col("w.number"), "street": F.col("w.street")})
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), parsed(F.col("s_suppkey"), F.col("s_acctbal")).alias("g")).withColumns({"number": F.col("g.number"), "street": F.col("g.street")})
    d = c.join(s, ["nation", "number", "street"]).withColumn("s", address.assess(F.col("w"), F.col("g"))).filter("not s.rejected").select("c_custkey", "s_suppkey", F.col("s.score").cast("long").alias("score"))
    return groups.rank_candidates(d, ["c_custkey"], F.col("score"), ["s_suppkey"]).filter("rank <= 3").withColumn("rank", F.col("rank").cast("long"))


def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(F.round(groups.agreement(F.col("l_quantity"), F.col("l_suppkey")), 6).alias("confidence"), (F.count_distinct("l_suppkey") >= 2).alias("independent"))


def geo_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a label against the label's first one."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.get("embedding", F.lit(0)) * 0.1 + 51.5).alias("lat"), (F.get("embedding", F.lit(1)) * 0.1 - 0.1).alias("lng"))
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "lat", "lng"), "vec_id").alias("f"))
    d = e.join(first, "label").withColumn("distance_km", numbers.haversine_km(F.col("f.lat"), F.col("f.lng"), F.col("lat"), F.col("lng"))).withColumn("same_postcode", F.col("vec_id") % 3 == F.col("f.vec_id") % 3)
    far = groups.ambiguous(d, ["label"], 20.0)
    return far.join(d.groupBy("label").agg(F.round(F.max("distance_km"), 3).alias("farthest_km")), "label")


def two_pass_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order: strictly of the same nation and balance sign, else of the nation, as suppliers."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 5000).alias("rich"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 5000).alias("rich"), F.col("s_suppkey").alias("supplier"), F.col("s_name"))
    return matching.two_pass(c, s, ["nation", "rich"], ["nation"], ["c_custkey"], "supplier", "s_name").select("c_custkey", "supplier", "pass")


def confidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's value against its dearest order's: a priority in words, or a price as a number that is up to 3 % off."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    best = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderpriority", "o_totalprice"), F.struct("o_totalprice", "o_orderkey")).alias("b"), F.count(F.lit(1)).alias("n"))
    k = F.col("c_custkey")
    price = F.floor("b.o_totalprice").cast("long")
    value = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("1 urgent")).when(k % 4 == 2, F.lit("5-LOW")).otherwise(F.floor(price + price * (k % 61 - 30) / 1000).cast("long").cast("string"))
    found = F.when(k % 4 == 3, price.cast("string")).otherwise(F.col("b.o_orderpriority"))
    d = c.join(best, k == F.col("o_custkey"), "left").select("c_custkey", value.alias("value"), F.when(k % 2 == 0, F.lit(0.6)).otherwise(F.lit(0.95)).alias("confidence"), found.alias("found"), F.least(F.lit(1.0), 0.5 + 0.05 * F.coalesce("n", F.lit(0))).alias("new"))
    m = merge.merge_value(F.col("value"), F.col("confidence"), F.col("found"), F.col("new"))
    return d.select("c_custkey", m.alias("m")).select("c_custkey", "m.value", F.round("m.confidence", 4).alias("confidence"), "m.outcome")


def tolerant_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    same = numbers.tolerant_equal(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("equal"))


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, of which some already end like a second one of the name."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" (2)"))).otherwise(F.col("p_name")).alias("name"))
    return sequence.unique_names(p, "name", ["p_partkey"], "unique_name").select("p_partkey", "unique_name")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    j = merge.model_json(wrapped, "k bigint")
    return read(spark, sf_dir, "events").select("event_id", j["k"].alias("k"))


def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name shares words with a type: the whole name, its first word, its last word; the first tier that hits."""
    p = read(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    tiers = F.array(F.struct(F.lit(0).alias("tier"), F.col("p_name").alias("term")), F.struct(F.lit(1).alias("tier"), F.get(w, F.lit(0)).alias("term")), F.struct(F.lit(2).alias("tier"), F.element_at(w, -1).alias("term")))
    terms = p.select("p_partkey", F.explode(tiers).alias("t")).select("p_partkey", "t.tier", F.lower("t.term").alias("term"))
    other = p.select(F.lower("p_name").alias("hay"), F.explode(F.array_distinct(F.array(F.lower("p_name"), F.lower(F.get(w, F.lit(0)))))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("hits"))
    found = matching.tiered(terms.join(other, "term"), ["p_partkey"], "tier")
    return found.select("p_partkey", F.col("tier").cast("long").alias("tier"), "hits")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles of vectors, on a page of a thousand units a side for each label."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.get("embedding", F.lit(i)).cast("double") * 100).alias(f"e{i}") for i in range(4)])
    return e.withColumn("box", F.struct(F.least("e0", "e1").alias("x0"), F.least("e2", "e3").alias("y0"), F.greatest("e0", "e1").alias("x1"), F.greatest("e2", "e3").alias("y1")))


def spatial_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each even rectangle the last odd one of its label with which it shares more than half of the area that both cover."""
    e = boxes(spark, sf_dir)
    images = e.filter("vec_id % 2 = 0").select("label", F.col("vec_id").alias("image_id"), "box")
    links = e.filter("vec_id % 2 = 1").select("label", F.col("vec_id").alias("link_id"), F.col("box").alias("rect"), F.col("vec_id").alias("place"))
    return matching.covering(images, links, ["label"]).select("image_id", "link_id")


def status_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.element_at(F.array(*[F.lit(s) for s in STATUS_LINES]), (k % len(STATUS_LINES) + 1).cast("int"))
    t = F.when(k % 3 == 0, line).when(k % 3 == 1, F.concat(line, F.lit("; "), F.col("p_name"))).otherwise(F.concat(F.lit("Bright "), F.lower(line), F.lit(" space near "), F.col("p_name")))
    d = read(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    p = text.partition_status(F.col("t"))
    return d.select("p_partkey", text.status_tag(F.col("t")).alias("tag"), p["status"].alias("status"), p["rest"].alias("rest"), text.reclassify(F.col("t"), F.lit(""))["status"].alias("moved"), text.floor_token(F.col("t")).alias("floor"))


#: Lines of status_tag (fixed values).
STATUS_LINES = ["Fully  Fitted", "CAT A", "plug & play", "Fitted (2nd hand)", "12th floor", "Under Offer", "Fit-out underway", "meeting rooms", "CAT B - custom fit out opportunity", "unfurnished", "available immediately", "Vacant possession", "cat a fitted", "Third floor", "custom fit out opportunity", "fully managed"]


QUERIES = {
    f.__name__: f
    for f in (
        *(link_segments, asof_backward, asof_forward_barrier, nearest_within_6, rate_limit_60s, range_block_join, price_pair, postcode_address_parse, area_consensus, richest_sibling, donor_fanout, candidate_ranking),
        *(source_agreement, geo_ambiguity, two_pass_match, confidence_merge, tolerant_equality, unique_names, json_extract, tiered_match, spatial_iou, status_tag),
    )
}

_W = "(PARTITION BY user_id ORDER BY ts, event_id"
#: Stated anew, not taken from the functions, which these queries check.
_STATUS = r"(?i)\b(fully\s+fitted|partially\s+fitted|fit[\s\-]*outs?\s+underway|cat\s*[ab]\s*[-–—]\s*custom\s+fit\s*outs?\s+opportunity|cat\s*[ab]\s*[-–—]?\s*(custom\s+)?fit\s*outs?(\s+opportunity)?|cat\s*[ab]\s*fitted|custom\s+fit\s*out\s+opportunity|cat\s*[ab]\b|fitted|plug\s*(and|&)\s*play|available\s+(now|immediately)|immediate(\s+availability)?|vacant\s+possession|coming\s+soon|under\s+offer)\b"
_STATUS_NAME = """CASE WHEN {0} = '' THEN '' WHEN regexp_matches({0}, 'fully\\s+fitted') THEN 'Fully Fitted' WHEN regexp_matches({0}, 'partially\\s+fitted') THEN 'Partially Fitted' WHEN contains({0}, 'underway') THEN 'Fitout Underway'
  WHEN regexp_matches({0}, 'cat\\s*a.*(custom|opportunity)') THEN 'CAT A - Custom Fit Out Opportunity' WHEN regexp_matches({0}, 'cat\\s*a') THEN 'CAT A' WHEN regexp_matches({0}, 'cat\\s*b.*(custom|opportunity)') THEN 'CAT B - Custom Fit Out Opportunity' WHEN regexp_matches({0}, 'cat\\s*b') THEN 'CAT B'
  WHEN {0} = 'fitted' THEN 'Fitted' WHEN regexp_matches({0}, 'plug') THEN 'Plug and Play' WHEN {0} = 'available now' THEN 'Available now' WHEN contains({0}, 'immediate') THEN 'Immediate' WHEN contains({0}, 'vacant') THEN 'Vacant possession'
  WHEN contains({0}, 'coming') THEN 'Coming soon' WHEN contains({0}, 'offer') THEN 'Under offer' ELSE upper({0}[1]) || {0}[2:] END"""
_LINES = "['" + "', '".join(STATUS_LINES) + "']"
SQL = {
    "link_segments": f"WITH s AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER {_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM events) SELECT user_id, segment, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY user_id, segment",
    "asof_backward": f"WITH s AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER {_W} ROWS UNBOUNDED PRECEDING) AS view_id FROM events) SELECT event_id, view_id FROM s WHERE event_type = 'click'",
    "asof_forward_barrier": f"WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase')), s AS (SELECT *, lead(event_type) OVER {_W}) AS t, lead(event_id) OVER {_W}) AS n FROM e) SELECT event_id, CASE WHEN t = 'purchase' THEN n END AS purchase_id FROM s WHERE event_type = 'click'",
    "nearest_within_6": f"""WITH e AS (SELECT *, row_number() OVER {_W}) AS at FROM events),
p AS (SELECT x.event_id, s.event_id AS sid, row_number() OVER (PARTITION BY x.event_id ORDER BY abs(s.at - x.at), s.at) AS k FROM e x JOIN e s ON s.user_id = x.user_id AND abs(s.at - x.at) <= 6 WHERE x.event_type = 'error' AND s.event_type = 'signup')
SELECT e.event_id, p.sid AS signup_id FROM e LEFT JOIN p ON p.event_id = e.event_id AND p.k = 1 WHERE e.event_type = 'error'""",
    "rate_limit_60s": f"""WITH s AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window,
  epoch_us(ts) - epoch_us(lag(ts) OVER {_W})) AS gap_us FROM events) SELECT *, in_window <= 5 AS allowed FROM s""",
    "range_block_join": "SELECT b.user_id, b.event_id AS begin, count(*) AS rows, max(e.event_id) AS last_event FROM events b JOIN events e ON e.user_id = b.user_id AND e.event_id >= b.event_id AND e.event_id < b.event_id + 400 WHERE b.event_type = 'purchase' GROUP BY b.user_id, b.event_id",
    "price_pair": """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS s, CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END AS m, CASE WHEN l_linenumber % 2 <> 1 THEN floor(l_extendedprice / 100 * 100 + 0.5::DOUBLE) / 100 END AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m IS NULL AND f <> 0 AND s <> 0 THEN floor(f * s / 12 * 100 + 0.5::DOUBLE) / 100 ELSE m END AS pcm, CASE WHEN f IS NULL AND m <> 0 AND s <> 0 THEN floor(m * 12 / s * 100 + 0.5::DOUBLE) / 100 ELSE f END AS psf FROM p""",
    "postcode_address_parse": "SELECT c_custkey, (c_custkey % 90 + 10)::VARCHAR AS number, 'unit house' AS name, 'market street' AS street, 'london' AS locality, 'EC' || (c_custkey % 4 + 1) || 'A ' || (c_custkey % 9 + 1) || 'AB' AS postcode, (c_custkey % 90 + 10) || ' Market St' AS street_only FROM customer",
    "area_consensus": "SELECT o_custkey, CASE WHEN count(DISTINCT nullif(o_orderpriority, '')) = 1 THEN max(o_orderpriority) END AS priority, count(*) AS orders FROM orders GROUP BY o_custkey",
    "richest_sibling": "SELECT p_brand, p_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS k FROM part) WHERE k = 1",
    "donor_fanout": "WITH d AS (SELECT *, first_value(o_orderkey) OVER w AS dk, first_value(o_orderstatus) OVER w AS dst FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN dk END AS donor_order, CASE WHEN o_totalprice < 50000 THEN dst ELSE o_orderstatus END AS status FROM d",
    "candidate_ranking": """WITH s AS (SELECT c_custkey, s_suppkey, (89 + CASE WHEN c_acctbal > 5000 AND s_acctbal > 5000 THEN 8 ELSE 0 END + CASE WHEN c_custkey % 4 = s_suppkey % 4 THEN 10 ELSE -5 END)::BIGINT AS score
  FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey % 10 = s_suppkey % 10 AND c_custkey % 3 = s_suppkey % 3),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""",
    "source_agreement": "SELECT l_partkey, round(least(1.0::DOUBLE, max(l_quantity) / 100 + 0.08::DOUBLE * (count(DISTINCT l_suppkey) - 1)), 6) AS confidence, count(DISTINCT l_suppkey) >= 2 AS independent FROM lineitem GROUP BY l_partkey",
    "geo_ambiguity": """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE * 0.1::DOUBLE + 51.5::DOUBLE AS lat, embedding[2]::DOUBLE * 0.1::DOUBLE - 0.1::DOUBLE AS lng FROM embeddings),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM e),
d AS (SELECT e.label, e.vec_id % 3 = f.vec_id % 3 AS same, 2 * 6371 * asin(sqrt(least(1.0::DOUBLE, power(sin(radians(e.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(e.lat)) * power(sin(radians(e.lng - f.lng) / 2), 2)))) AS km FROM e JOIN f ON f.label = e.label AND f.k = 1)
SELECT label, bool_or(km > 20 OR km <= 0.03 AND NOT same) AS ambiguous, round(max(km), 3) AS farthest_km FROM d GROUP BY label""",
    "two_pass_match": """WITH c AS (SELECT c_custkey, c_nationkey AS n, c_acctbal > 5000 AS r FROM customer), s AS (SELECT s_nationkey AS n, s_acctbal > 5000 AS r, s_suppkey, s_name FROM supplier),
a AS (SELECT n, r, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY n, r ORDER BY s_name, s_suppkey) AS k FROM s) WHERE k = 1), b AS (SELECT n, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s_name, s_suppkey) AS k FROM s) WHERE k = 1)
SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS supplier, CASE WHEN a.s_suppkey IS NOT NULL THEN 'strict' WHEN b.s_suppkey IS NOT NULL THEN 'relaxed' END AS pass FROM c LEFT JOIN a ON a.n = c.n AND a.r = c.r LEFT JOIN b ON b.n = c.n""",
    "confidence_merge": """WITH o AS (SELECT o_custkey, o_orderpriority, floor(o_totalprice)::BIGINT AS price, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS k FROM orders),
d AS (SELECT c_custkey, price, CASE WHEN c_custkey % 4 = 3 THEN floor(price + price * (c_custkey % 61 - 30) / 1000)::BIGINT END AS guess, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1 urgent' WHEN 2 THEN '5-LOW' ELSE floor(price + price * (c_custkey % 61 - 30) / 1000)::BIGINT::VARCHAR END AS value,
  CASE WHEN c_custkey % 2 = 0 THEN 0.6::DOUBLE ELSE 0.95::DOUBLE END AS conf, CASE WHEN c_custkey % 4 = 3 THEN price::VARCHAR ELSE o_orderpriority END AS found, least(1.0::DOUBLE, 0.5::DOUBLE + 0.05::DOUBLE * coalesce(n, 0)) AS new FROM customer LEFT JOIN o ON o_custkey = c_custkey AND k = 1),
m AS (SELECT *, CASE WHEN coalesce(found, '') = '' THEN 'no evidence' WHEN value = '' THEN CASE WHEN new >= 0.7::DOUBLE THEN 'filled' ELSE 'too weak' END
  WHEN guess IS NOT NULL AND abs(guess - price) <= greatest(1.0::DOUBLE, guess * 0.02::DOUBLE) OR guess IS NULL AND replace(lower(value), '-', ' ') = replace(lower(found), '-', ' ') THEN 'agrees' WHEN conf < 0.8::DOUBLE AND new > conf THEN 'replaced' ELSE 'conflict' END AS outcome FROM d)
SELECT c_custkey, coalesce(CASE WHEN outcome IN ('filled', 'replaced') THEN found ELSE value END, '') AS value, round(CASE WHEN outcome IN ('filled', 'replaced') THEN new ELSE conf END, 4) AS confidence, outcome FROM m""",
    "tolerant_equality": "SELECT l_returnflag, count(*) AS rows, count(*) FILTER (abs(l_extendedprice - l_quantity * p_retailprice) <= greatest(1.0::DOUBLE, abs(l_extendedprice) * 0.02::DOUBLE)) AS equal FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag",
    "unique_names": """WITH p AS (SELECT p_partkey, p_name, p_partkey % 5 = 0 AS two FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_name, two ORDER BY p_partkey) AS k FROM p),
f AS (SELECT p_name, min(p_partkey) FILTER (two) AS first_two, min(p_partkey) FILTER (NOT two AND k = 2) AS second_plain FROM n GROUP BY p_name)
SELECT p_partkey, CASE WHEN first_two IS NULL OR second_plain < first_two THEN CASE WHEN two THEN p_name || ' (2) (' || k + 1 || ')' WHEN k = 1 THEN p_name ELSE p_name || ' (' || k || ')' END
  WHEN two THEN CASE WHEN k = 1 THEN p_name || ' (2)' ELSE p_name || ' (2) (' || k || ')' END WHEN k = 1 THEN p_name ELSE p_name || ' (' || k + 1 || ')' END AS unique_name FROM n JOIN f USING (p_name)""",
    "json_extract": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "tiered_match": """WITH t AS (SELECT p_partkey, unnest([0, 1, 2])::BIGINT AS tier, lower(unnest([p_name, str_split(p_name, ' ')[1], str_split(p_name, ' ')[-1]])) AS term FROM part),
h AS (SELECT term, count(*) AS hits FROM (SELECT p_partkey, unnest(list_distinct([lower(p_name), lower(str_split(p_name, ' ')[1])])) AS term FROM part) GROUP BY term),
m AS (SELECT *, min(tier) OVER (PARTITION BY p_partkey) AS best FROM t JOIN h USING (term)) SELECT p_partkey, tier, hits FROM m WHERE tier = best""",
    "spatial_iou": """WITH e AS (SELECT vec_id, label, least(embedding[1], embedding[2])::DOUBLE * 100 AS x0, greatest(embedding[1], embedding[2])::DOUBLE * 100 AS x1, least(embedding[3], embedding[4])::DOUBLE * 100 AS y0, greatest(embedding[3], embedding[4])::DOUBLE * 100 AS y1 FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS other, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS total FROM e a JOIN e b USING (label) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
m AS (SELECT vec_id, max(other) AS link_id FROM p WHERE shared > 0 AND shared / (total - shared) > 0.5 GROUP BY vec_id) SELECT e.vec_id AS image_id, m.link_id FROM e LEFT JOIN m USING (vec_id) WHERE e.vec_id % 2 = 0""",
    "status_tag": rf"""WITH l AS (SELECT p_partkey, p_name, {_LINES}[p_partkey % 16 + 1] AS s FROM part),
t AS (SELECT *, regexp_replace(CASE p_partkey % 3 WHEN 0 THEN s WHEN 1 THEN s || '; ' || p_name ELSE 'Bright ' || lower(s) || ' space near ' || p_name END, '\s+', ' ', 'g') AS t, regexp_replace(s, '\s+', ' ', 'g') AS item FROM l),
w AS (SELECT *, lower(regexp_extract(t, '{_STATUS}')) AS f, lower(regexp_extract(regexp_replace(item, ' \([^)]*\)$', ''), '{_STATUS}')) AS g FROM t),
n AS (SELECT *, {_STATUS_NAME.format('f')} AS tag, {_STATUS_NAME.format('g')} AS own, regexp_extract(item, ' (\([^)]*\))$', 1) AS note FROM w),
o AS (SELECT *, own <> '' AND (regexp_full_match(regexp_replace(lower(item), ' \([^)]*\)$', ''), '{_STATUS}') OR regexp_replace(lower(item), '[^a-z0-9]', '', 'g') = regexp_replace(lower(own), '[^a-z0-9]', '', 'g')) AS pure FROM n),
q AS (SELECT *, CASE WHEN pure AND note <> '' THEN own || ' ' || note ELSE own END AS full_tag FROM o),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND pure THEN full_tag ELSE tag END AS tag, CASE WHEN p_partkey % 3 <> 2 THEN CASE WHEN pure THEN full_tag WHEN p_partkey % 3 = 0 AND f <> 'fitted' THEN tag ELSE '' END WHEN f = 'fitted' THEN '' ELSE tag END AS status,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN pure THEN '' ELSE t END WHEN p_partkey % 3 = 1 THEN CASE WHEN pure THEN p_name ELSE t END ELSE t END AS rest, s FROM q)
SELECT p_partkey, tag, status, rest, status AS moved, CASE s WHEN 'Third floor' THEN '3' WHEN '12th floor' THEN '12' WHEN 'Fitted (2nd hand)' THEN '2' ELSE '' END AS floor FROM r""",
}

"""Queries over listings: layouts, the fixed schema, checks, addresses, media. Their inputs are composed from the keys of the tables, as these
hold no listings; the SQL says what each composed input must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, text
from ..operators import evidence, finishing, groups, layouts, listings, matching, tables, validation
from ..sources import sinks
from .page_queries import read


def _s(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(x)


def _cat(*x) -> Column:
    return F.concat(*[_s(v) for v in x])


def composed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, table rows): a document per supplier, in one of nine layouts."""
    k = F.col("doc_id")
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("doc_id"))
    name, street = _cat("House ", k), _cat(k % 90 + 1, " Mill Street W1A ", k % 9 + 1, "BB")
    size, desks, price = 100 + k % 800, k % 40 + 1, 1000 + k % 9000
    long = F.when(F.floor(k / 9) % 5 == 4, F.repeat(F.lit("x"), 250)).otherwise(name)
    texts = {
        0: ["Hello", "SOHO", name, street, "Available", "London", "1st floor", street, "Seats", desks, "Size", _cat(size, " sqft"), "Price (monthly)", _cat("£", price, " pcm"), "Price (per sqft)", _cat("£", 50 + k % 50, " per sqft"), "Available", "London", "2nd floor", "Seats", "10", "Size", "600 sqft"],
        1: ["News", "CITY FRINGE", name, "(annex)", "- 3rd Floor", "Sqft: 1,500", _cat("Desks: ", desks, "-", desks + 4), _cat("Price: £", price), "Av: now", "Gamma Court", "Sqft: 900", "Desks: 9", "Price: £3,000", "Av: now"],
        2: ["Intro", _cat(k % 90 + 1, " Long Lane, London EC1A ", k % 9 + 1, "AB"), "First Floor", _cat(desks, " Desks, bright"), _cat("£", price, " Per Month"), "Second Floor", "8 Desks", "£2,000 Per Month", "5 Short St, London W1B 3CC", "Ground Floor", "4 desks"],
        3: ["ad", "CURRENT AVAILABILITY", "MAYFAIR", name, "- Roof terrace", "- Gym", *layouts.MARKER, "1st", _cat(desks, " - ", desks + 2, " desks"), _cat(size, " - 2,000"), "£80 - £90", "2nd", "10 desks", size, "£70", "Epsilon", *layouts.MARKER, "note", "Ground", "6 desks", "500", "£60"],
        5: [long, _cat(k % 90 + 1, " Baker Lane"), "London N1 7AA", "Contact: Sales", "Proposed space", _cat("Unit 4 - ", size, " sq ft"), _cat(desks, " desks"), "£6,500 + VAT", "Deposit"],
    }
    out = F.lit("")
    for i, parts in texts.items():
        out = F.when(k % 9 == i, F.concat_ws("\n", *[_s(x) for x in parts])).otherwise(out)
    grids = {
        4: [["list"], ["Building", "Floor", "Size", "Num of Desks", "Market Price", "Sale Price!", "Includes"], [name, "1", size, desks, "£50", "N/A", "wifi"], ["", "", "", "", "", "", ""]],
        6: [["Availability"], ["Soho", "Floor", "Size", "Desks"], [name, "1st", "1,000", desks], ["", "2nd", "5", ""]],
        7: [[_cat(name, ", 1 High St EC1A 1BB"), "Soho"], ["Unit/Floor", "Sq Ft", "Desks", "Per Month"], ["1st", size, desks, "£50"], ["2nd", "200", "6", "£60"], ["Beta, 2 Low St W1A 2AA", "City"], ["Unit/Floor", "Sq Ft", "Desks", "Per Month"], ["3rd", "300", "30 + 3 MR", "£70"]],
        8: [["Building", "Floor", "Size", "Rent"], [name, "4th", size, _cat("£", price)], [name, "", "", ""]],
    }
    cells = F.array().cast("array<array<string>>")
    for i, grid in grids.items():
        cells = F.when(k % 9 == i, F.array(*[F.array(*[_s(x) for x in row]) for row in grid])).otherwise(cells)
    docs = s.select("doc_id", out.alias("text"), F.lit("").alias("sender"), F.lit("").alias("subject"))
    rows = s.select("doc_id", F.lit(0).alias("table_idx"), F.posexplode(cells).alias("row_idx", "cells"))
    return docs, rows


def layout_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = layouts.dispatch(*composed_documents(spark, sf_dir))
    number = lambda c: F.regexp_replace(c, r"\.0$", "")
    return d.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "parser", "area", "building", "floor_unit", number("size").alias("size"), number("desks").alias("desks"), number("price_pcm").alias("price_pcm"), "price_psf")


def first_match_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parser took a document; none where its rows were not plausible."""
    docs, rows = composed_documents(spark, sf_dir)
    won = layouts.dispatch(docs, rows).groupBy("doc_id").agg(F.min("parser").alias("parser"), F.min("rule_rank").cast("long").alias("rule_rank"), F.count(F.lit(1)).alias("rows"))
    return docs.select("doc_id").join(won, "doc_id", "left")


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property blocks with their bounds, and the links of a sheet's rows within them."""
    _, rows = composed_documents(spark, sf_dir)
    b = tables.property_blocks(rows).select("doc_id", "address_row", "end_row").distinct()
    links = rows.select("doc_id", "row_idx").filter("row_idx % 2 = 0")
    hit = matching.range_join(links, b, ["doc_id"], "row_idx", "address_row", "end_row", 100)
    return hit.groupBy("doc_id", "address_row", "end_row").agg(F.count(F.lit(1)).alias("links")).select("doc_id", F.col("address_row").cast("long").alias("address_row"), F.col("end_row").cast("long").alias("end_row"), "links")


def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows in several orders and wordings, mapped to targets by key words; cells read through the map."""
    k = F.col("s_suppkey")
    heads = [["Building", "Floor", "Size (sq ft)", "Rent", "Contact"], ["Unit", "Monthly price", "Area sq ft", "Address", "Desks"], ["Name", "Comment", "x", "y", "z"]]
    values = {"b": _cat("House ", k), "f": _cat(k % 9 + 1, "th"), "s": F.when(k % 4 == 0, "n/a").otherwise(_cat(k % 3 + 1, ",", F.lpad((k % 1000).cast("string"), 3, "0"))), "p": F.when(k % 5 == 0, "").otherwise(_cat("£", k % 90 + 10)), "d": _cat(k % 20 + 1, "-", k % 20 + 5), "c": F.lit("Ann")}
    bodies = [["b", "f", "s", "p", "c"], ["f", "p", "s", "b", "d"], ["b", "f", "s", "p", "c"]]
    grid = F.array().cast("array<array<string>>")
    for i in range(3):
        rows = [F.array(F.lit("Availability list")), F.array(*[F.lit(h) for h in heads[i]]), F.array(*[values[v] for v in bodies[i]])]
        grid = F.when(k % 3 == i, F.array(*rows)).otherwise(grid)
    d = read(spark, sf_dir, "supplier").select(k.cast("long").alias("doc_id"), F.lit(0).alias("table_idx"), F.posexplode(grid).alias("row_idx", "cells"))
    return tables.read_grid(d).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), "building", "floor", "size", F.col("desks").cast("long").alias("desks"), "price")


def composed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    # the file is small and its scan one task, but a listing takes a hundred times longer to compose and judge than to read
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")
    return c.select(
        F.col("c_nationkey").cast("long").alias("doc_id"), k.cast("long").alias("ordinal"), F.when(k % 10 == 0, "").otherwise(F.upper("c_mktsegment")).alias("area"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, _cat("House ", k)).otherwise(_cat("House ", k, ", ", k % 90 + 1, " Mill  St, London ec1a", k % 9 + 1, "bb")).alias("building"), _cat(k % 9, "th").alias("floor_unit"),
        F.when(k % 6 == 0, "").otherwise(_cat(k % 3 + 1, ",", F.lpad((k % 1000).cast("string"), 3, "0"))).alias("size"), _cat(k % 50).alias("desks"), F.when(k % 2 == 0, _cat("£", 1000 + k % 9000)).otherwise("").alias("price_pcm"),
        F.when(k % 2 == 1, _cat(40 + k % 50)).otherwise("").alias("price_psf"), F.when(k % 3 == 0, "N/A").otherwise("1").alias("sale_price"), F.when(k % 4 == 0, "Fitted; Roof terrace").otherwise("Roof terrace near the river").alias("features"),
        F.when(k % 8 == 0, "ann@b.example").otherwise("Ann Lee, ann@b.example, 020 7946 0000").alias("contacts"), F.when(k % 3 == 1, "12 Months minimum").otherwise("").alias("min_term"),
        F.when(k % 11 == 0, "").when(k % 11 == 1, "https://a.example/x.png").when(k % 11 == 2, "nowhere").otherwise(_cat("https://a.example/", k, ".pdf")).alias("brochure_url"),
        F.when(k % 13 == 0, "https://10.1.1.1/p.png").when(k % 13 == 1, _cat("https://A.example/", k, ".pdf?utm_source=x")).otherwise("").alias("floor_plan_url"), F.when(k % 17 == 0, F.lit("https://a.example/media/1")).otherwise("").alias("high_res_url"),
    )


def listings_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings.normalize(composed_listings(spark, sf_dir))
    return d.select("ordinal", "area", "building", "assigned_agents", "property_postcode", "postcode_status", "for_sale", "to_let", "size_sqft", "desks_max", "price_pcm", "price_psf", "min_term", "special_features", "state_of_space")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = listings.normalize(composed_listings(spark, sf_dir), judged=False)  # no rule reads features or state of space
    return d.withColumns({"source_file": F.when(F.col("ordinal") % 19 == 0, "").otherwise("a.eml"), "source_url": F.when(F.col("ordinal") % 23 == 0, "nowhere").otherwise(""), "source_url_expected": F.col("ordinal") % 2 == 0})


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.issues(_checked(spark, sf_dir), "ordinal", validation.listing_rules()).select("ordinal", "field", "message", "severity")


def qa_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the review sheet, counted."""
    d = validation.with_issues(_checked(spark, sf_dir), validation.listing_rules())
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "conflict").when(F.col("o_orderstatus") == "F", "unreachable").otherwise("ok")
    notes = o.select((F.col("o_custkey") % 25).cast("long").alias("doc_id"), F.lit("").alias("building"), status.alias("status"), F.lit("link").alias("resource_type"), F.concat(F.lit("order "), "o_orderstatus").alias("detail"), F.lit("").alias("original_url"))
    return sinks.qa_rows(d, notes).groupBy("field", "message", "severity").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("files"))


def photo_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of a supplier, each once by address: eight photos and four plans at most, the dearest first."""
    li = read(spark, sf_dir, "lineitem")
    ordinal = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kind = F.when(F.col("l_partkey") % 4 == 0, "floorplan").when(F.col("l_partkey") % 4 == 1, "brochure").otherwise("photo")
    a = li.select("l_suppkey", _cat("HTTPS://A.example/", F.col("l_partkey"), "?utm_source=", F.col("l_linenumber")).alias("url"), F.lit("").alias("content_hash"), kind.alias("class"), F.col("l_extendedprice").alias("confidence"), ordinal.cast("long").alias("ordinal"))
    return listings.pick_assets(a, ["l_suppkey"]).select("l_suppkey", "class", "ordinal", "confidence")


def address_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' addresses against three candidates each."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.cast("long").alias("k"))
    own = F.when(F.col("k") % 5 == 0, _cat(" EC2A ", F.col("k") % 9 + 1, "AA")).otherwise("")
    asked = c.select("k", _cat(F.col("k") % 90 + 1, " Mill St, London", own).alias("address"), F.lit("").alias("postcode"))
    one = lambda n, number, code, source: F.struct(F.lit(n).alias("ordinal"), _cat(number, " Mill Street, London ", code).alias("address"), source.alias("source"))
    n = F.col("k") % 90 + 1
    cands = F.array(
        one(1, F.when(F.col("k") % 3 == 0, n + 1).otherwise(n), _cat("EC1A ", F.col("k") % 9 + 1, "BB"), F.when(F.col("k") % 2 == 0, F.lit("brochure")).otherwise(F.lit("geocoder"))),
        one(2, F.when(F.col("k") % 7 == 0, n).otherwise(n + 2), F.lit("W1A 1AA"), F.lit("agent_listing")),
        one(3, n, F.when(F.col("k") % 4 == 0, _cat("EC1A ", F.col("k") % 9 + 1, "BB")).otherwise(F.lit("")), F.lit("searched")),
    )
    d = listings.resolve_addresses(asked, c.select("k", F.explode(cands).alias("c")).select("k", "c.*"), "k")
    return d.select("k", "status", "postcode", F.round("confidence", 4).alias("confidence"), F.array_join("sources", "+").alias("sources"), "n_considered")


def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    b = F.when(k % 4 == 0, _cat("Thirty One Alfred Place, W", k % 9 + 1)).when(k % 4 == 1, _cat("House ", k, ", ", k % 90, " Jermyn Street, SW1Y")).when(k % 4 == 2, _cat(k % 90, " Swallow Place, W1")).otherwise(_cat("House ", k))
    digits = address.spelled_to_digits(b)
    tried = address.retry_candidates(b, F.when(digits != b, digits).otherwise(""))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(tried, "|").alias("tried"))


def media_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents out of photo fields, then blank brochures from PDF sources."""
    d = finishing.clear_documents(listings.normalize(composed_listings(spark, sf_dir)))
    files = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.when(F.col("n_nationkey") % 3 == 0, "list.eml").when(F.col("n_nationkey") % 3 == 1, "Brochure.pdf").otherwise("list.pdf").alias("filename"), F.when(F.col("n_nationkey") % 6 == 2, "model").otherwise("grid").alias("method"), _cat("https://s.example/", F.col("n_nationkey")).alias("source_url"))
    d = finishing.seed_brochures(d, files)
    return d.select("ordinal", "brochure_url", "floor_plan_url", "high_res_url", F.array_join(F.transform("cleared", lambda x: x["code"]), ",").alias("cleared"), finishing.usable_plan(F.col("floor_plan_url")).alias("plan"))


def photo_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings with photos of their lines; their brands' pages by the greatest need."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.transform(F.sort_array(F.collect_set("l_linenumber")), lambda n: _cat("https://a.example/media/", n, "?w=", n)).alias("c"))
    p = read(spark, sf_dir, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    own = F.when(F.col("p_partkey") % 3 == 0, "https://a.example/page").when(F.col("p_partkey") % 3 == 1, "https://a.example/p.jpg").otherwise("")
    d = p.select("p_brand", F.col("p_partkey").cast("long").alias("k"), finishing.photo_need(own, F.when(F.col("p_partkey") % 4 != 0, F.col("c"))).alias("need"))
    return finishing.in_need_order(d, "p_brand", "need", "k").select("p_brand", F.col("need").cast("long").alias("need"), "first", F.col("place").cast("long").alias("place"))


def seeds_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of a page in storing order, plans first, and the further seeds of its address."""
    from .page_queries import asset_candidates
    from ..functions import urls

    a = asset_candidates(spark, sf_dir)
    c = urls.asset_class(F.col("u"), F.col("anchor"), F.lit(""), F.col("width"), F.col("height"), F.col("seen"), F.col("near"))
    placed = finishing.plans_first(a.withColumn("class", c["class"]), ["page_id"], "pos")
    first = placed.groupBy("page_id").agg(F.min_by("pos", "place").alias("first_pos"), F.count_if(F.col("class") == "floorplan").alias("plans"))
    k = F.col("page_id")
    seeds = finishing.extra_seeds(F.col("url"), F.array(F.concat("url", F.lit("#x")), F.when(k % 2 == 0, F.lit("https://pitch.com/a")).otherwise(F.lit("https://p.example/A?crop=1")), F.lit("https://P.example/A"), F.lit("mailto:x"), _cat("https://p.example/", k)))
    return first.join(read(spark, sf_dir, "pages").select("page_id", F.array_join(seeds, " ").alias("seeds")), "page_id").select("page_id", F.col("first_pos").cast("long").alias("first_pos"), "plans", "seeds")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact blocks at the end of composed e-mails: by websites, by names, with lone dashes put to the next line."""
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*[F.lit(n) for n in ("Ann Lee", "Bob O'Neil", "Cara Day-Ray")]), (k % 3 + 1).cast("int"))
    phone = _cat("0207 ", 100 + k % 900, " ", 1000 + k % 9000)
    web = ["Intro", "-", "Roof terrace", "Contact", name, "Sales Manager", phone, "ann@a.example", "WWW.a.example", "Dan Fox", "Director", F.when(k % 2 == 0, phone).otherwise("call us"), "dan at a", "www.a.example", name, "Sales Manager", phone, "x@y.example", "www.a.example", "Copyright 2026", "Eve Ray", "a", "b", "c", "www.b.example"]
    named = ["-", "-", "Gym", "Get in touch", name, "+44 (0) 7435 9", _cat(10 + k % 90, " 956"), "Dan Fox", "no phone", name, "+44 0000 000 000", "View in browser", "Eve Ray", "+44 1111 111 111"]
    lines = F.when(k % 2 == 0, F.array(*[_s(x) for x in web])).otherwise(F.array(*[_s(x) for x in named]))
    d = read(spark, sf_dir, "supplier").select(k.cast("long").alias("doc_id"), F.posexplode(lines).alias("at", "line"))
    d = finishing.merge_dashes(d, ["doc_id"], "at", "line")
    got = finishing.contacts_by_website(d).unionByName(finishing.contacts_by_name(d))
    first = d.groupBy("doc_id").agg(F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), 1, 2), "/").alias("first_lines"))
    return first.join(got, "doc_id", "left")


def name_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first tier of their name that a type's words hold, and by all tiers together."""
    p = read(spark, sf_dir, "part")
    building = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(", W1"))).otherwise(F.col("p_name"))
    tiers = p.select("p_partkey", F.posexplode(text.name_tiers(building)).alias("tier", "term"))
    pages = p.select(F.lower("p_name").alias("term"), F.col("p_size").alias("page")).distinct()
    found = tiers.join(pages, "term")
    first = matching.tiered(found, ["p_partkey"], "tier").groupBy("p_partkey").agg(F.count_distinct("page").alias("first_pages"), F.min("tier").cast("long").alias("tier"))
    return first.join(matching.all_tiers(found, ["p_partkey"], "page").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("all_pages")), "p_partkey")


def plan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor plans in composed pages, as addresses, in attributes, or named only by the element around them."""
    k = F.col("page_id")
    html = _cat(
        "<p><a href='#floorplan'>Floor plan</a><a href='/p/", k, ".pdf'>Particulars</a><a class='btn floor-plan' href='/m/", k, ".png'><b>View</b> it</a>",
        "<img src='x.png'><div data-modal-path='/cms/floor-plan/", k, "'></div><a href='https://b.example/Floorplan.pdf?x=", k, "'>see <i>plan</i></a><a href='/terms'>Floor plan</a><span data-src='../floor_plan.jpg'>",
    )
    d = read(spark, sf_dir, "pages").select(_cat(k).alias("key"), _cat("https://a.example/x/", k % 3, "/y").alias("url"), html.cast("binary").alias("payload"))
    return evidence.plan_candidates(d).select("key", F.col("ordinal").cast("long").alias("ordinal"), "url", "label", "kind")


def file_brochures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = groups.brochures(composed_listings(spark, sf_dir), ["doc_id"])
    return d.select("doc_id", F.col("brochures").cast("long").alias("brochures"))


QUERIES = {
    f.__name__: f
    for f in (
        *(plan_links, file_brochures, layout_dispatch, first_match_dispatch, block_rows, header_mapping, listings_normalized, validation_issues, qa_union, photo_caps, address_resolution, retry_candidates),
        *(media_cleared, photo_needs, seeds_and_order, contacts, name_pages),
    )
}

_L = "(SELECT s_suppkey AS k, 'House ' || s_suppkey AS name, s_suppkey % 90 + 1 AS no, 100 + s_suppkey % 800 AS size, s_suppkey % 40 + 1 AS desks, 1000 + s_suppkey % 9000 AS price, (s_suppkey // 9) % 5 = 4 AS too_long FROM supplier)"
_PARSED = f"""l AS {_L},
r(k, ordinal, parser, rule_rank, area, building, floor_unit, size, desks, price_pcm, price_psf) AS (
  SELECT k, 0, 'button cards', 0, 'Soho', name || ', ' || no || ' Mill Street W1A ' || (k % 9 + 1) || 'BB', '1st floor', size::VARCHAR, desks::VARCHAR, price::VARCHAR, (50 + k % 50)::VARCHAR FROM l WHERE k % 9 = 0
  UNION ALL SELECT k, 1, 'button cards', 0, 'Soho', name || ', ' || no || ' Mill Street W1A ' || (k % 9 + 1) || 'BB', '2nd floor', '600', '10', '', '' FROM l WHERE k % 9 = 0
  UNION ALL SELECT k, 0, 'labelled lines', 1, 'City Fringe', name || ' (annex)', '3rd Floor', '1500', (desks + 4)::VARCHAR, price::VARCHAR, '' FROM l WHERE k % 9 = 1
  UNION ALL SELECT k, 1, 'labelled lines', 1, 'City Fringe', 'Gamma Court', '', '900', '9', '3000', '' FROM l WHERE k % 9 = 1
  UNION ALL SELECT k, 0, 'address cards', 2, '', no || ' Long Lane, London EC1A ' || (k % 9 + 1) || 'AB', 'First Floor', '', desks::VARCHAR, price::VARCHAR, '' FROM l WHERE k % 9 = 2
  UNION ALL SELECT k, 1, 'address cards', 2, '', no || ' Long Lane, London EC1A ' || (k % 9 + 1) || 'AB', 'Second Floor', '', '8', '2000', '' FROM l WHERE k % 9 = 2
  UNION ALL SELECT k, 2, 'address cards', 2, '', '5 Short St, London W1B 3CC', 'Ground Floor', '', '4', '', '' FROM l WHERE k % 9 = 2
  UNION ALL SELECT k, 0, 'marker tables', 3, 'Mayfair', name, '1st', '2000', (desks + 2)::VARCHAR, '', '90' FROM l WHERE k % 9 = 3
  UNION ALL SELECT k, 1, 'marker tables', 3, 'Mayfair', name, '2nd', size::VARCHAR, '10', '', '70' FROM l WHERE k % 9 = 3
  UNION ALL SELECT k, 2, 'marker tables', 3, 'Mayfair', 'Epsilon', 'Ground', '500', '6', '', '60' FROM l WHERE k % 9 = 3
  UNION ALL SELECT k, 0, 'summary grid', 4, '', name, '1', size::VARCHAR, desks::VARCHAR, '£50', '' FROM l WHERE k % 9 = 4
  UNION ALL SELECT k, 0, 'brochure text', 5, '', name || ', ' || no || ' Baker Lane, London N1 7AA', 'Unit 4', size::VARCHAR, desks::VARCHAR, '6500', '' FROM l WHERE k % 9 = 5 AND NOT too_long
  UNION ALL SELECT k, 0, 'availability sheet', 6, '', name, '1st', '1000', desks::VARCHAR, '', '' FROM l WHERE k % 9 = 6
  UNION ALL SELECT k, 0, 'property blocks', 7, 'Soho', name || ', 1 High St EC1A 1BB', '1st', size::VARCHAR, desks::VARCHAR, '50', '' FROM l WHERE k % 9 = 7
  UNION ALL SELECT k, 1, 'property blocks', 7, 'Soho', name || ', 1 High St EC1A 1BB', '2nd', '200', '6', '60', '' FROM l WHERE k % 9 = 7
  UNION ALL SELECT k, 2, 'property blocks', 7, 'City', 'Beta, 2 Low St W1A 2AA', '3rd', '300', '30', '70', '' FROM l WHERE k % 9 = 7
  UNION ALL SELECT k, 0, 'availability sheet', 6, '', name, '4th', size::VARCHAR, '', price::VARCHAR, '' FROM l WHERE k % 9 = 8)"""
_C = r"""c AS (SELECT c_custkey AS k, c_nationkey AS doc, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS area,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'House ' || c_custkey ELSE 'House ' || c_custkey || ', ' || (c_custkey % 90 + 1) || ' Mill St, London ec1a' || (c_custkey % 9 + 1) || 'bb' END AS building,
  CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN '' ELSE 'EC1A ' || (c_custkey % 9 + 1) || 'BB' END AS code, CASE WHEN c_custkey % 6 <> 0 THEN ((c_custkey % 3 + 1) * 1000 + c_custkey % 1000)::DOUBLE END AS size,
  CASE WHEN c_custkey % 2 = 0 THEN (1000 + c_custkey % 9000)::DOUBLE END AS pcm, CASE WHEN c_custkey % 2 = 1 THEN (40 + c_custkey % 50)::DOUBLE END AS psf,
  CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN 'https://a.example/x.png' WHEN c_custkey % 11 = 2 THEN 'nowhere' ELSE 'https://a.example/' || c_custkey || '.pdf' END AS brochure,
  CASE WHEN c_custkey % 13 = 0 THEN 'https://10.1.1.1/p.png' WHEN c_custkey % 13 = 1 THEN 'https://A.example/' || c_custkey || '.pdf?utm_source=x' ELSE '' END AS plan, CASE WHEN c_custkey % 17 = 0 THEN 'https://a.example/media/1' ELSE '' END AS high FROM customer),
n AS (SELECT * FROM c WHERE building <> '' OR area <> '')"""
_I = f"""{_C}, i AS (
  SELECT k, doc, 'source_file' AS field, 'source file name lost' AS message, 'error' AS severity FROM n WHERE k % 19 = 0
  UNION ALL SELECT k, doc, 'source_url', 'source address invalid', 'error' FROM n WHERE k % 23 = 0 UNION ALL SELECT k, doc, 'source_url', 'source address missing', 'warning' FROM n WHERE k % 23 <> 0 AND k % 2 = 0
  UNION ALL SELECT k, doc, 'building', 'building missing', 'error' FROM n WHERE building = '' UNION ALL SELECT k, doc, 'property_address_1', 'address missing', 'error' FROM n WHERE building = ''
  UNION ALL SELECT k, doc, 'size_sqft', 'size missing', 'warning' FROM n WHERE size IS NULL UNION ALL SELECT k, doc, 'property_postcode', 'postcode needs manual lookup', 'warning' FROM n WHERE code = ''
  UNION ALL SELECT k, doc, 'brochure_url', 'address unusable', 'error' FROM n WHERE k % 11 IN (1, 2) UNION ALL SELECT k, doc, 'floor_plan_url', 'address unusable', 'error' FROM n WHERE k % 13 = 0
  UNION ALL SELECT k, doc, 'floor_plan_url', 'same as brochure_url', 'error' FROM n WHERE k % 13 = 1 AND k % 11 NOT IN (0, 1, 2))"""
from .page_queries import SQL as _PAGE_SQL  # noqa: E402

_ASSETS = _PAGE_SQL["asset_classes"].rpartition("SELECT c[1] AS class")[0]
SQL = {
    "seeds_and_order": f"""{_ASSETS.replace("g AS (SELECT page_id, CASE", "g AS (SELECT page_id, k - page_id AS pos, CASE")}, m AS (SELECT page_id, arg_min(pos, CASE WHEN c[1] = 'floorplan' THEN pos ELSE pos + 1000000 END) AS first_pos, count(*) FILTER (c[1] = 'floorplan') AS plans FROM g GROUP BY page_id)
SELECT page_id, first_pos, plans, CASE WHEN page_id % 2 = 0 THEN 'https://P.example/A' ELSE 'https://p.example/A?crop=1' END || ' https://p.example/' || page_id AS seeds FROM m""",
    "plan_links": """SELECT page_id::VARCHAR AS key, o::BIGINT AS ordinal, replace(replace(u, '%k', page_id::VARCHAR), '%x', 'https://a.example') AS url, label, kind
  FROM pages, (VALUES (0, '%x/cms/floor-plan/%k', 'Floor plan', 'page'), (1, '%x/x/floor_plan.jpg', 'Floor plan', 'image'), (2, '%x/m/%k.png', 'View it', 'image'), (3, 'https://b.example/Floorplan.pdf?x=%k', 'see plan', 'pdf')) t(o, u, label, kind)""",
    "file_brochures": "SELECT c_nationkey AS doc_id, count(DISTINCT CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN 'x' WHEN c_custkey % 11 = 2 THEN 'n' ELSE c_custkey::VARCHAR END) AS brochures FROM customer GROUP BY c_nationkey",
    "layout_dispatch": f"WITH {_PARSED} SELECT k AS doc_id, ordinal::BIGINT AS ordinal, parser, area, building, floor_unit, size, desks, price_pcm, price_psf FROM r",
    "first_match_dispatch": f"WITH {_PARSED}, g AS (SELECT k, any_value(parser) AS parser, any_value(rule_rank)::BIGINT AS rule_rank, count(*) AS rows FROM r GROUP BY k) SELECT l.k AS doc_id, parser, rule_rank, rows FROM l LEFT JOIN g USING (k)",
    "block_rows": "SELECT s_suppkey AS doc_id, a::BIGINT AS address_row, e::BIGINT AS end_row, 2::BIGINT AS links FROM supplier, (VALUES (0, 4), (4, 7)) t(a, e) WHERE s_suppkey % 9 = 7",
    "header_mapping": """SELECT s_suppkey AS doc_id, 2::BIGINT AS row_idx, 'House ' || s_suppkey AS building, (s_suppkey % 9 + 1) || 'th' AS floor, CASE WHEN s_suppkey % 4 <> 0 THEN ((s_suppkey % 3 + 1) * 1000 + s_suppkey % 1000)::DOUBLE END AS size,
  CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey % 20 + 5 END::BIGINT AS desks, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 90 + 10)::DOUBLE END AS price FROM supplier WHERE s_suppkey % 3 < 2""",
    "listings_normalized": f"""WITH {_C} SELECT k AS ordinal, area, building, CASE WHEN k % 8 = 0 THEN 'Unknown' ELSE 'Ann Lee' END AS assigned_agents, code AS property_postcode, CASE WHEN code <> '' THEN 'source' ELSE '' END AS postcode_status, k % 3 <> 0 AS for_sale, true AS to_let, size AS size_sqft, (k % 50)::DOUBLE AS desks_max,
  CASE WHEN pcm IS NULL AND psf IS NOT NULL AND size IS NOT NULL THEN floor(psf * size / 12 * 100 + 0.5::DOUBLE) / 100 ELSE pcm END AS price_pcm, CASE WHEN psf IS NULL AND pcm IS NOT NULL AND size IS NOT NULL THEN floor(pcm * 12 / size * 100 + 0.5::DOUBLE) / 100 ELSE psf END AS price_psf,
  CASE WHEN k % 3 = 1 THEN '12 months' ELSE '' END AS min_term, CASE WHEN k % 4 = 0 THEN 'Roof terrace' ELSE 'Roof terrace near the river' END AS special_features, CASE WHEN k % 4 = 0 THEN 'Fitted' ELSE '' END AS state_of_space FROM n""",
    "validation_issues": f"WITH {_I} SELECT k AS ordinal, field, message, severity FROM i",
    "qa_union": f"""WITH {_I}, o AS (SELECT o_custkey % 25 AS doc, 'link' AS field, 'order ' || o_orderstatus AS message, CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'warning' END AS severity FROM orders WHERE o_orderstatus IN ('P', 'F')),
u AS (SELECT doc, field, message, severity FROM i UNION ALL SELECT * FROM o), e AS (SELECT DISTINCT doc FROM n ANTI JOIN u USING (doc)), a AS (SELECT * FROM u UNION ALL SELECT doc, '', 'No issues found', 'info' FROM e)
SELECT field, message, severity, count(*) AS rows, count(DISTINCT doc) AS files FROM a GROUP BY ALL""",
    "photo_caps": """WITH a AS (SELECT l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber AS ordinal, l_extendedprice AS confidence, CASE l_partkey % 4 WHEN 0 THEN 'floorplan' WHEN 1 THEN 'brochure' ELSE 'photo' END AS class FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY ordinal) AS n FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, class ORDER BY confidence DESC, ordinal) AS m FROM b WHERE n = 1)
SELECT l_suppkey, class, ordinal, confidence FROM c WHERE class = 'brochure' OR m <= CASE class WHEN 'photo' THEN 8 ELSE 4 END""",
    "address_resolution": """WITH d AS (SELECT c_custkey AS k, c_custkey % 3 <> 0 AS a, c_custkey % 7 = 0 AS b, c_custkey % 4 = 0 AS c, 'EC1A ' || (c_custkey % 9 + 1) || 'BB' AS code, CASE WHEN c_custkey % 2 = 0 THEN 'brochure' ELSE 'geocoder' END AS s FROM customer)
SELECT k, CASE WHEN k % 5 = 0 THEN 'RESOLVED_FROM_SOURCE' WHEN (a OR c) AND b THEN 'CONFLICTING_CANDIDATES' WHEN a AND k % 2 = 0 THEN 'RESOLVED_FROM_BROCHURE' WHEN a OR c THEN 'RESOLVED_FROM_VALIDATED_LOOKUP' WHEN b THEN 'RESOLVED_FROM_PROPERTY_PAGE' ELSE 'MANUAL_REVIEW_REQUIRED' END AS status,
  CASE WHEN k % 5 = 0 THEN 'EC2A ' || (k % 9 + 1) || 'AA' WHEN (a OR c) AND b THEN '' WHEN a OR c THEN code WHEN b THEN 'W1A 1AA' ELSE '' END AS postcode,
  CASE WHEN k % 5 = 0 THEN 1.0 WHEN (a OR c) AND b OR NOT (a OR b OR c) THEN 0.0 WHEN a AND c THEN 0.97 ELSE 0.89 END::DOUBLE AS confidence,
  CASE WHEN k % 5 = 0 THEN 'source_file' WHEN (a OR c) AND b OR NOT (a OR b OR c) THEN '' WHEN a AND c THEN s || '+searched' WHEN a THEN s WHEN c THEN 'searched' ELSE 'agent_listing' END AS sources, CASE WHEN k % 5 = 0 THEN 0 ELSE 3 END::BIGINT AS n_considered FROM d""",
    "retry_candidates": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '31 Alfred Place, W' || (c_custkey % 9 + 1) || '|Thirty One Alfred Place' WHEN 1 THEN 'House ' || c_custkey || ', ' || c_custkey % 90 || ' Jermyn Street|' || c_custkey % 90 || ' Jermyn Street, SW1Y|' || c_custkey % 90 || ' Jermyn Street'
  WHEN 2 THEN c_custkey % 90 || ' Swallow Place' ELSE 'House ' || c_custkey END AS tried FROM customer""",
    "media_cleared": f"""WITH {_C}, o AS (SELECT doc, count(DISTINCT nullif(lower(building), '')) = 1 AS one FROM n GROUP BY doc),
f AS (SELECT doc, doc % 3 <> 0 AND (doc % 3 = 1 OR doc % 6 = 2 OR one) AS seeded FROM o),
p AS (SELECT n.*, seeded, plan <> '' AND (k % 13 = 1) AS gone FROM n JOIN f USING (doc))
SELECT k AS ordinal, CASE WHEN brochure = '' AND seeded THEN 'https://s.example/' || doc ELSE brochure END AS brochure_url, CASE WHEN gone THEN '' ELSE plan END AS floor_plan_url, high AS high_res_url, CASE WHEN gone THEN 'FLOOR_PLAN_DOCUMENT_PLACEHOLDER_CLEARED' ELSE '' END AS cleared, CASE WHEN gone THEN '' ELSE plan END AS plan FROM p""",
    "photo_needs": """WITH l AS (SELECT l_partkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_partkey), d AS (SELECT p_brand, p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN coalesce(n, 0) ELSE 0 END + CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS n FROM part LEFT JOIN l ON l_partkey = p_partkey),
g AS (SELECT p_brand, min(CASE WHEN n = 0 THEN 0 WHEN n < 5 THEN 1 ELSE 2 END)::BIGINT AS need, min(k) AS first FROM d GROUP BY p_brand) SELECT *, row_number() OVER (ORDER BY need, first, p_brand) AS place FROM g""",
    "contacts": """WITH s AS (SELECT s_suppkey AS k, ['Ann Lee', 'Bob O''Neil', 'Cara Day-Ray'][s_suppkey % 3 + 1] AS n, '0207 ' || (100 + s_suppkey % 900) || ' ' || (1000 + s_suppkey % 9000) AS p FROM supplier)
SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'Intro/- Roof terrace' ELSE '- -/Gym' END AS first_lines, CASE WHEN k % 2 = 0 THEN n || ', ann@a.example, ' || p || ', Dan Fox, ' || p ELSE n || ', +44 (0) 7435 9' || (10 + k % 90) || ' 956, Dan Fox' END AS contacts FROM s""",
    "name_pages": """WITH p AS (SELECT p_partkey, lower(p_name) AS n, p_size FROM part), w AS (SELECT n AS term, count(DISTINCT p_size) AS pages FROM p GROUP BY n)
SELECT p_partkey, pages AS first_pages, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS tier, pages AS all_pages FROM p JOIN w ON term = n""",
}

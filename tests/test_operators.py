from __future__ import annotations

import random

from pyspark.sql import functions as F

from fenwright.operators import groups, layouts, listings, matching, sequence, tables, validation


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, "s@x", "news") for i, t in enumerate(texts)], "doc_id string, text string, sender string, subject string")


def rows_of(spark, *grids):
    return spark.createDataFrame([(f"d{d}", 0, i, r) for d, g in enumerate(grids) for i, r in enumerate(g)], "doc_id string, table_idx int, row_idx int, cells array<string>")


def test_order_does_not_depend_on_partitions(spark):
    base = [(k, i, random.Random(i).choice("ab")) for k in range(3) for i in range(40)]
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(base)
        df = spark.createDataFrame(base, "k int, i int, v string").repartition(3 + seed)
        out = sequence.carry_forward(df, F.when(F.col("v") == "a", F.col("i")), "last_a", ["k"], ["i"])
        out = matching.nearest_within(out, F.col("v") == "b", F.col("i"), "near", ["k"], ["i"], 6)
        results.append(sorted(map(tuple, out.collect()), key=str))
    assert results[0] == results[1]


def test_chunks_cover_all_rows_with_overlap(spark):
    for n in (1, 24, 25, 26, 48, 49, 100):
        df = spark.range(n).withColumn("k", F.lit(1))
        got = sequence.chunk_rows(df, ["k"], ["id"]).groupBy("chunk").agg(F.sort_array(F.collect_list("id")).alias("r")).orderBy("chunk").collect()
        chunks = [r["r"] for r in got]
        assert sorted({x for c in chunks for x in c}) == list(range(n)) and all(len(c) <= 25 for c in chunks)
        assert all(a[-2:] == b[:2] for a, b in zip(chunks, chunks[1:]))


def test_char_chunks(spark):
    df = spark.createDataFrame([(["x" * 100] * 60,), (["y" * 20000, "z"],), ([],)], "l array<string>")
    a, b, c = [[(x["begin"], x["end"]) for x in r[0]] for r in df.select(sequence.chunk_chars(F.col("l"), 25, 2000)).collect()]
    assert a[0][0] == 0 and a[-1][1] == 60 and all(e - s <= 25 and (e - s) * 101 <= 2000 for s, e in a) and all(y[0] == x[1] - 2 for x, y in zip(a, a[1:]))
    assert b == [(0, 1), (1, 2)] or b[0] == (0, 1)
    assert c == []


def test_consume_once(spark):
    r = spark.createDataFrame([("d", 0, "Alpha"), ("d", 1, "Alpha"), ("d", 2, "Beta"), ("d", 3, "")], "doc_id string, ordinal int, name string")
    links = spark.createDataFrame([("d", 5, "see ALPHA  house"), ("d", 3, "alpha beta"), ("d", 9, "beta")], "doc_id string, row_no int, row_text string")
    got = {x["ordinal"]: x["row_no"] for x in matching.consume_once(r, links, "doc_id").collect()}
    assert got == {0: 3, 1: 5, 2: 9, 3: None}


def test_range_join_and_zip(spark):
    p = spark.createDataFrame([("s", 4), ("s", 7), ("t", 5)], "sheet string, row_number int")
    r = spark.createDataFrame([("s", 3, 6, "one"), ("s", 6, 90, "two")], "sheet string, begin int, end int, name string")
    assert {(x["row_number"], x["name"]) for x in matching.range_join(p, r, ["sheet"], "row_number", "begin", "end", 10).collect()} == {(4, "one"), (7, "two")}
    z = matching.zip_by_order(p, r.select("sheet", "begin", "name"), ["sheet"], "row_number", "begin").orderBy("sheet", "row_number").collect()
    assert [x["name"] for x in z] == ["one", "two", None]


def test_groups(spark):
    d = spark.createDataFrame([("a", "x", 1), ("a", "", 2), ("b", "x", 3), ("b", "y", 4)], "g string, v string, i int")
    assert {r["g"]: r["c"] for r in d.groupBy("g").agg(groups.consensus(F.col("v")).alias("c")).collect()} == {"a": "x", "b": None}
    assert {r["owners"] for r in groups.boilerplate(spark.createDataFrame([("h", i) for i in range(3)], "item string, owner int"), "item", "owner").collect()} == {3}


CARDS = "Hello\nSOHO\nAlpha House\n8 Mill Street W1A 2BB\nAvailable\nLondon\n1st floor\n8 Mill Street W1A 2BB\nSeats\n20\nSize\n1,200 sqft\nPrice (monthly)\n£9,000 pcm\nPrice (per sqft)\n£90 per sqft\nAvailable\nLondon\n2nd floor\nSeats\n10\nSize\n600 sqft"
LABELS = "News\nCITY FRINGE\nBeta Court\n(annex)\n- 3rd Floor\nSqft: 1,500\nDesks: 20-24\nPrice: £7,000\nAv: now\nGamma\nSqft: 900\nDesks: 9\nPrice: £3,000\nAv: now"
ADDRESSES = "Intro\n10 Long Lane, London EC1A 9AB\nFirst Floor\n12 Desks, bright\n£3,500 Per Month\nSecond Floor\n8 Desks\n£2,000 Per Month\n5 Short St, London W1B 3CC\nGround Floor\n4 desks"
MARKERS = "ad\nCURRENT AVAILABILITY\nMAYFAIR\nDelta House\n- Roof terrace\n- Gym\nAvailable\nDesk space\nSq ft\nPrice (psf)\n1st\n20 - 24 desks\n1,000 - 2,000\n£80 - £90\n2nd\n10 desks\n800\n£70\nEpsilon\nAvailable\nDesk space\nSq ft\nPrice (psf)\nnote\nGround\n6 desks\n500\n£60"
BROCHURE = "The Foundry\n5 Baker Lane\nLondon N1 7AA\nContact: Sales\nProposed space\nUnit 4 - 1,150 sq ft\n22 desks\n£6,500 + VAT\nDeposit"


def test_layouts(spark):
    tables_ = rows_of(spark, [["x"]])
    got = layouts.dispatch(docs(spark, CARDS, LABELS, ADDRESSES, MARKERS, BROCHURE), tables_).orderBy("doc_id", "ordinal").collect()
    seen = {}
    for r in got:
        seen.setdefault((r["doc_id"], r["parser"]), []).append((r["area"], r["building"], r["floor_unit"], r["size"], r["desks"], r["price_pcm"], r["price_psf"]))
    assert seen[("d0", "button cards")] == [("Soho", "Alpha House, 8 Mill Street W1A 2BB", "1st floor", "1200", "20", "9000", "90"), ("Soho", "Alpha House, 8 Mill Street W1A 2BB", "2nd floor", "600", "10", "", "")]
    assert seen[("d1", "labelled lines")] == [("City Fringe", "Beta Court (annex)", "3rd Floor", "1500", "24", "7000", ""), ("City Fringe", "Gamma", "", "900", "9", "3000", "")]
    assert [x[1:3] + x[4:6] for x in seen[("d2", "address cards")]] == [("10 Long Lane, London EC1A 9AB", "First Floor", "12", "3500"), ("10 Long Lane, London EC1A 9AB", "Second Floor", "8", "2000"), ("5 Short St, London W1B 3CC", "Ground Floor", "4", "")]
    assert seen[("d3", "marker tables")] == [("Mayfair", "Delta House", "1st", "2000", "24", "", "90"), ("Mayfair", "Delta House", "2nd", "800", "10", "", "70"), ("Mayfair", "Epsilon", "Ground", "500", "6", "", "60")]
    assert seen[("d4", "brochure text")] == [("", "The Foundry, 5 Baker Lane, London N1 7AA", "Unit 4", "1150", "22", "6500", "")]


def test_tables(spark):
    summary = [["list"], ["Building", "Floor", "Size", "Num of Desks", "Market Price", "Sale Price!", "Includes"], ["A", "1", "100", "5", "£50", "N/A", "wifi"], ["", "", "", "", "", "", ""]]
    sheet = [["Availability"], ["Soho", "Floor", "Size", "Desks"], ["Alpha", "1st", "1,000", "10"], ["", "2nd", "5", ""]]
    blocks = [["Alpha, 1 High St EC1A 1BB", "Soho"], ["Unit/Floor", "Sq Ft", "Desks", "Per Month"], ["1st", "100", "5", "£50"], ["2nd", "200", "6", "£60"], ["Beta, 2 Low St W1A 2AA", "City"], ["Unit/Floor", "Sq Ft", "Desks", "Per Month"], ["3rd", "300", "30 + 3 MR", "£70"]]
    grid = [["Building", "Floor", "Size", "Rent"], ["Gamma", "4th", "400", "£90"]]
    rows = rows_of(spark, summary, sheet, blocks, grid)
    got = layouts.dispatch(docs(spark), rows).orderBy("doc_id", "ordinal").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["parser"], r["building"], r["floor_unit"], r["desks"]))
    assert by["d0"] == [("summary grid", "A", "1", "5")]
    assert [x[1:3] for x in by["d1"]] == [("Alpha", "1st")]
    assert [x[1:] for x in by["d2"]] == [("Alpha, 1 High St EC1A 1BB", "1st", "5"), ("Alpha, 1 High St EC1A 1BB", "2nd", "6"), ("Beta, 2 Low St W1A 2AA", "3rd", "30")]
    assert by["d3"][0][1:3] == ("Gamma", "4th")
    ends = {(r["address_row"], r["end_row"]) for r in tables.property_blocks(rows).collect()}
    assert ends == {(0, 4), (4, 7)}


def listing(spark, **changes):
    base = {"doc_id": "d", "ordinal": 0, "area": "SOHO", "building": "Alpha, 12 High St, London EC1A 1BB", "floor_unit": "1st", "size": "1,200", "desks": "10", "price_pcm": "£6,000", "price_psf": "", "sale_price": "N/A", "features": "Cat A; Roof terrace; Gym", "contacts": "Ann, a@b.co"}
    base |= changes
    return spark.createDataFrame([base], "doc_id string, ordinal int, area string, building string, floor_unit string, size string, desks string, price_pcm string, price_psf string, sale_price string, features string, contacts string")


def test_listing_life(spark):
    one = listings.normalize(listing(spark))
    r = one.first()
    assert (r["area"], r["size_sqft"], r["price_psf"], r["for_sale"], r["assigned_agents"], r["property_postcode"], r["state_of_space"]) == ("Soho", 1200.0, 60.0, False, "Ann", "EC1A 1BB", "CAT A")
    assert listings.normalize(listing(spark, building="", area=" ")).count() == 0
    geo = spark.createDataFrame([("Alpha, 12 High St, London EC1A 1BB, UK", "12 High Street, London", 51.5, -0.1, "EC1A 1BB"), ("Alpha, 12 High St, London EC1A 1BB, UK", "99 High Street", 1.0, 1.0, "")], "query string, address string, lat double, lng double, postcode string")
    found = spark.createDataFrame([("Zeta", "1 X St", 2)], "name string, address string, sources int")
    placed = listings.resolve_places(one, geo, found).first()
    assert placed["lat"] == 51.5 and placed["postcode_status"] == "source" and placed["property_address_1"] == "12 High St"
    ev = spark.createDataFrame([("d", 0, "min_term", "12 months", 0.9), ("d", 0, "min_term", "6 months", 0.8), ("d", 0, "floor_unit", "9th", 0.99)], "doc_id string, ordinal int, field string, value string, confidence double")
    merged = listings.apply_evidence(one, ev, ["min_term", "floor_unit"], locked=("floor_unit",)).first()
    assert merged["min_term"] == "12 months" and merged["floor_unit"] == "1st" and merged["outcomes"] == {"min_term": "filled", "floor_unit": "conflict"}
    p = listings.with_provenance(one, "grid").first()["provenance"]
    assert "building" in p and "min_term" not in p
    assert [c for c in listings.export(one).columns] == [n for n, _ in listings.COLUMNS] and listings.export(one).first()["To Let"] == "Yes"


def test_validation(spark):
    d = listings.normalize(listing(spark, size="")).withColumns({"source_file": F.lit("a.eml"), "source_url": F.lit(""), "source_url_expected": F.lit(True), "brochure_url": F.lit("https://a.b/x.png"), "high_res_url": F.lit("https://a.b/x.png")})
    got = {(r["field"], r["severity"]) for r in validation.issues(d, "doc_id", validation.listing_rules()).collect()}
    assert got == {("source_url", "warning"), ("size_sqft", "warning"), ("brochure_url", "error"), ("high_res_url", "error")}


def test_assets_and_media(spark):
    a = spark.createDataFrame([("k", f"https://a/{i % 10}.jpg?utm_source={i}", f"h{i}", "photo", 0.5 + i / 100, i) for i in range(20)], "k string, url string, content_hash string, class string, confidence double, ordinal int")
    got = listings.pick_assets(a, ["k"]).collect()
    assert len(got) == 8 and {r["ordinal"] for r in got} == set(range(2, 10))
    rows = spark.createDataFrame([("d", 0, "A", "", "", "x"), ("d", 1, "a", "b", "c", "")], "doc_id string, ordinal int, building string, brochure_url string, floor_plan_url string, high_res_url string")
    shared = {r["ordinal"]: tuple(r)[3:] for r in listings.share_media(rows).collect()}
    assert shared == {0: ("b", "c", "x"), 1: ("b", "c", "")}


def test_unique_names_skip_taken_ones(spark):
    given = ["a", "a", "a (2)", "b", "a", "a (2)", "b (3)", "b", "b", "c (2)", "c", "c"]
    d = spark.createDataFrame(list(enumerate(given)), "i int, n string").repartition(3)
    got = [r["u"] for r in sequence.unique_names(d, "n", ["i"], "u").orderBy("i").collect()]
    taken, last, want = set(), {}, []
    for x in given:
        u = x
        while u in taken:
            last[x] = last.get(x, 1) + 1
            u = f"{x} ({last[x]})"
        taken.add(u)
        want.append(u)
    assert got == want and len(set(got)) == len(given)


def test_the_last_covering_link_counts(spark):
    images = spark.createDataFrame([("p", 1, (0.0, 0.0, 100.0, 100.0)), ("p", 2, (500.0, 500.0, 520.0, 510.0)), ("q", 3, (0.0, 0.0, 9.0, 9.0))], "page string, image_id int, box struct<x0: double, y0: double, x1: double, y1: double>")
    links = spark.createDataFrame([("p", 10, (1.0, 1.0, 99.0, 99.0), 1), ("p", 11, (0.0, 0.0, 90.0, 80.0), 2), ("p", 12, (40.0, 40.0, 44.0, 44.0), 3), ("p", 13, (0.0, 0.0, 400.0, 400.0), 4), ("q", 14, (0.0, 0.0, 9.0, 4.5), 1)], "page string, link_id int, rect struct<x0: double, y0: double, x1: double, y1: double>, place int")
    got = {r["image_id"]: r["link_id"] for r in matching.covering(images, links, ["page"]).collect()}
    assert got == {1: 11, 2: None, 3: None}  # contained and containing ones fail, and so does exactly a half


def test_resolution(spark):
    r = spark.createDataFrame([(1, "12 High St, London EC1A 1BB", ""), (2, "12 High St", ""), (3, "12 High St", ""), (4, "12 High St", ""), (5, "12 High St", "")], "k int, address string, postcode string")
    c = spark.createDataFrame(
        [(2, "12 High Street EC1A 1BB", "brochure", 1), (2, "12 High Street, EC1A 1BB", "geocoder", 2), (2, "14 High Street W1A 1AA", "geocoder", 3), (3, "12 High Street EC1A 1BB", "a", 1), (3, "12 High Street W1A 1AA", "b", 2), (4, "12 High Street", "a", 1), (5, "12 High Street W1A 1AA", "landlord_page", 1), (5, "12 high street w1a 1aa", "landlord_page", 2)],
        "k int, address string, source string, ordinal int",
    )
    got = {x["k"]: (x["status"], x["postcode"], round(x["confidence"], 2), x["sources"], x["n_considered"]) for x in listings.resolve_addresses(r, c, "k").collect()}
    assert got == {
        1: ("RESOLVED_FROM_SOURCE", "EC1A 1BB", 1.0, ["source_file"], 0), 2: ("RESOLVED_FROM_BROCHURE", "EC1A 1BB", 0.93, ["brochure", "geocoder"], 3), 3: ("CONFLICTING_CANDIDATES", "", 0.0, [], 2),
        4: ("MANUAL_REVIEW_REQUIRED", "", 0.0, [], 1), 5: ("RESOLVED_FROM_PROPERTY_PAGE", "W1A 1AA", 0.85, ["landlord_page"], 1),
    }

from __future__ import annotations

from pyspark.sql import functions as F

from fenwright.functions import dates, text, urls
from fenwright.operators import listings, matching


def test_small_functions(spark):
    r = spark.range(1).select(
        text.area_hint(F.lit("Fw_ Acme - Soho - Availability 14_07_2026.eml"), F.lit("Acme")).alias("hint"),
        text.area_of_sheet(F.lit("city fringe")).alias("sheet"),
        text.area_of_sheet(F.lit("Sheet1")).alias("none"),
        text.desk_extras(F.lit("30 + 3 MR + Collab")).alias("extras"),
        text.contact_block(F.array(F.lit("Ann Lee"), F.lit("ann@x.co"), F.lit("+44 20 7946"), F.lit("0000 11"), F.lit("see our site"))).alias("contact"),
        urls.tracker_target(F.lit("https://t.x/c?p=" + "https%253A%252F%252Fa.b%252Fc")).alias("target"),
        urls.tracker_target(F.lit('https://t.x/c?p=%7B%22url%22%3A%22https%3A%2F%2Fa.b%2Fz%22%7D')).alias("json"),
        urls.promoted(F.lit("https://a/page"), F.lit("https://a/b.pdf")).alias("best"),
        urls.promoted(F.lit("https://a/b.pdf"), F.lit("https://a/c.pdf")).alias("kept"),
        dates.quota_reset(F.lit("2026-07-14 20:00:00").cast("timestamp_ntz")).cast("string").alias("reset"),
    ).first()
    assert (r["hint"], r["sheet"], r["none"], r["extras"]) == ("Soho", "City Fringe", "", "3 MR + Collab")
    assert r["contact"] == "Ann Lee, ann@x.co, +44 20 79460000 11"
    assert (r["target"], r["json"], r["best"], r["kept"]) == ("https://a.b/c", "https://a.b/z", "https://a/b.pdf", "https://a/b.pdf")
    assert r["reset"] == "2026-07-15 08:00:00"


def test_notes_and_cache(spark):
    rows = spark.createDataFrame([("d", "Alpha House, Soho", "1st floor"), ("d", "Beta", "2nd")], "doc_id string, building string, floor string")
    notes = spark.createDataFrame([("d", "alpha house", "1st", "price drop", 0), ("d", "alpha", "1st", "later", 1)], "doc_id string, g string, i string, note string, ordinal int")
    assert {x["building"]: x["note"] for x in matching.nested_note(rows, notes, ["doc_id"], "building", "floor").collect()} == {"Alpha House, Soho": "price drop", "Beta": ""}
    cache = spark.createDataFrame([("Alpha House",), ("beta",)], "key string")
    assert [x["key"] for x in matching.invalidated(cache, "key", "ALPHA").collect()] == ["beta"]
    assert [x["key"] for x in matching.invalidated(cache, "key", "ALPHA", dry_run=True).collect()] == ["Alpha House"]


def test_final_photos(spark):
    assets = spark.createDataFrame([("d", 0, i, f"https://a/{i}.jpg") for i in range(6)], "doc_id string, ordinal int, place int, url string")
    v = spark.createDataFrame([("https://a/0.jpg", "ok", "h0"), ("https://a/1.jpg", "small", "h1"), ("https://a/2.jpg", "ok", "h0"), ("https://a/3.jpg", "ok", "h3"), ("https://a/5.jpg", "ok", "h5")], "url string, verdict string, content_hash string")
    own = spark.createDataFrame([("d", 0, "https://a/5.jpg?utm_source=x")], "doc_id string, ordinal int, floor_plan_url string")
    r = listings.final_photos(assets, v, own).first()
    assert r["photos"] == ["https://a/0.jpg", "https://a/3.jpg"] and r["high_res"] == "gallery"
    assert [x.split(": ")[1] for x in r["left_out"]] == ["small", "repeated", "not checked", "plan"]


def test_review_rows_judge_a_listing_at_most_twice(spark):
    from fenwright.operators import validation
    from fenwright.plans import listing_queries
    from fenwright.sources import sinks

    d = spark.createDataFrame([(1, ""), (1, "A"), (2, "B"), (3, "C"), (None, "")], "doc_id long, building string")
    d = validation.with_issues(d, [validation.rule("building", "marked rule", "error", F.col("building") == "", F.col("building"))])
    d = d.unionByName(d.filter("doc_id = 2").withColumns({"doc_id": F.lit(4).cast("long"), "issues": F.when(F.col("doc_id") != 2, F.col("issues"))}))
    notes = spark.createDataFrame([(3, "C", "conflict", "link", "seen", "u"), (2, "B", "ok", "link", "fine", "u"), (5, "", "unreachable", "link", "gone", "u")], "doc_id long, building string, status string, resource_type string, detail string, original_url string")
    rows = sinks.qa_rows(d, notes)
    assert {(r["doc_id"], r["message"]): r["severity"] for r in rows.collect()} == {(1, "marked rule"): "error", (None, "marked rule"): "error", (None, "No issues found"): "info", (2, "No issues found"): "info", (4, "No issues found"): "info", (3, "seen"): "error", (5, "gone"): "warning"}
    assert rows.count() == 7

    one = d.filter("doc_id = 1")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    per_use = plan(one.select("issues")).count("marked rule")
    assert plan(sinks.qa_rows(one, notes)).count("marked rule") <= 2 * per_use
    assert plan(d.select(urls.is_public(F.col("building")))).count("regexp_") < 50

    checked = listing_queries._checked(spark, "/root/testdata/sf0.001")
    assert checked.select(F.spark_partition_id().alias("p")).distinct().count() > 1

from __future__ import annotations

from fenwright.operators import media


def items(spark, *rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_id string, pos int, kind string, text string, url string").repartition(3)


IMG, LINK = "image", "link"


def test_groups_and_cards(spark):
    d = items(
        spark, (IMG, "Logo", "https://a/logo.png"), (IMG, "Photo", "https://a/1.jpg"), (LINK, "View Brochure", "https://a/1"), (LINK, "Floor plan", "https://a/1p"), (LINK, "other", "https://a/x"),
        (IMG, "Photo", "https://a/2.jpg"), (LINK, "https://a/2", "View brochure"), (IMG, "", "https://a/3.jpg"),
    )
    got = [tuple(r)[2:] for r in media.button_groups(d).orderBy("group").collect()]
    assert got == [("https://a/1.jpg", "https://a/1", "https://a/1p"), ("https://a/2.jpg", "https://a/2", "")]
    ls = spark.createDataFrame([("d", 0, "A"), ("d", 1, "B"), ("d", 2, "C")], "doc_id string, ordinal int, building string")
    assert [r["image"] for r in media.attach_groups(ls, d).orderBy("ordinal").collect()] == ["https://a/1.jpg", "https://a/2.jpg", ""]
    assert [(r["brochure"], r["photo"]) for r in media.card_assets(d).orderBy("card").collect()][0] == ("https://a/1", "https://a/1.jpg")


def test_next_image_and_names(spark):
    d = items(spark, (LINK, "one", "https://a/one"), (LINK, "", "https://a/blank"), (IMG, "x", "https://a/1.jpg"), (LINK, "two", "https://a/two"), (LINK, "Three", "https://a/three"), (IMG, "y", "https://a/2.jpg"))
    assert {r["url"]: r["plan"] for r in media.plans_after_links(d).collect()} == {"https://a/one": "https://a/1.jpg", "https://a/two": None, "https://a/three": "https://a/2.jpg"}
    names = spark.createDataFrame([("d", "THREE"), ("d", "none")], "doc_id string, building string")
    assert [(r["building"], r["photo"]) for r in media.photo_by_name(d, names).collect()] == [("THREE", "https://a/2.jpg")]
    assert [(r["building"], r["link"]) for r in media.link_by_name(d, names).collect()] == [("THREE", "https://a/three")]


def test_segments(spark):
    d = items(spark, (LINK, "intro", "https://a/i"), (IMG, "", "https://a/1.jpg"), (IMG, "", "https://a/1b.jpg"), (LINK, "Brochure", "https://a/b1"), (IMG, "", "https://a/2.jpg"), (LINK, "Floorplan", "https://a/p2"))
    ls = spark.createDataFrame([("d", 0, "A"), ("d", 1, "A"), ("d", 2, "B"), ("d", 3, "A")], "doc_id string, ordinal int, building string")
    got = [(r["images"], r["plan"], r["brochure"]) for r in media.attach_segments(ls, d).orderBy("ordinal").collect()]
    one, two = (["https://a/1.jpg", "https://a/1b.jpg"], "", "https://a/b1"), (["https://a/2.jpg"], "https://a/p2", "")
    assert got == [one, one, two, (None, None, None)]


def test_sheet_links(spark):
    ls = spark.createDataFrame([("d", "s", 0, 0, 4), ("d", "s", 1, 4, 9)], "doc_id string, sheet_name string, ordinal int, address_row int, end_row int")
    k = spark.createDataFrame([("d", "s", 3, "u3"), ("d", "s", 4, "u4"), ("d", "t", 5, "u5")], "doc_id string, sheet_name string, row_number int, url string")
    assert {r["ordinal"]: r["links"] for r in media.block_links(ls, k).collect()} == {0: ["u3"], 1: ["u4"]}
    rows = spark.createDataFrame([("d", 0, "Soho", "Alpha", "1st"), ("d", 1, "Soho", "Alpha", "2nd"), ("d", 2, "Soho", "Beta", "")], "doc_id string, ordinal int, area string, building string, floor_unit string")
    t = spark.createDataFrame([("d", "City", 1, "alpha spare"), ("d", "Soho", 2, "Alpha 2nd floor"), ("d", "Soho", 3, "Beta")], "doc_id string, sheet_name string, row_number int, row_text string")
    assert {r["ordinal"]: r["row_number"] for r in media.row_links(rows, t).collect()} == {1: 2, 0: 1, 2: 3}

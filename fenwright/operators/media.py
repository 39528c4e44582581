"""Links and images of e-mails and sheets bound to listings. items: doc_id, pos, kind (link or image), text, url, in document order; listings: doc_id,
ordinal and what else is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from . import matching, sequence

DOC, POS = ["doc_id"], ["pos"]


def real_image(alt: Column, url: Column) -> Column:
    """A picture of the property rather than a logo, an icon or a tracking pixel."""
    return (urls.canonical(url) != "") & urls.is_content_image(alt, url)


def link_kind(label: Column, url: Column) -> Column:
    return F.when(urls.is_floorplan_label(label), "floorplan").when(urls.is_brochure_link(label, url), "brochure").otherwise("other")


def button_groups(items: DataFrame) -> DataFrame:
    """(doc_id, group, image, brochure, floorplan): a group is a run of brochure and floor plan links without an image between; its image is the
    last one before it. A link whose label is the address is repaired."""
    swapped = F.col("text").rlike("^https?://") & ~F.col("url").rlike("^https?://")
    d = items.withColumns({"text": F.when(swapped, F.col("url")).otherwise(F.col("text")), "url": F.when(swapped, F.col("text")).otherwise(F.col("url"))})
    d = d.withColumn("what", F.when(F.col("kind") == "image", F.when(real_image(F.col("text"), F.col("url")), "image")).otherwise(link_kind(F.col("text"), F.col("url")))).filter("what in ('image', 'brochure', 'floorplan')")
    d = matching.as_of_backward(d, F.col("what") == "image", F.col("url"), "image", DOC, POS)
    before = F.lag("what").over(Window.partitionBy("doc_id").orderBy("pos"))
    buttons = F.col("what") != "image"
    d = sequence.islands(d.withColumn("before", before), buttons & (F.coalesce(F.col("before"), F.lit("image")) == "image"), "group", DOC, POS).filter(buttons)
    first = lambda w: F.min_by(F.when(F.col("what") == w, F.col("url")), F.when(F.col("what") == w, F.col("pos")))
    g = d.groupBy("doc_id", "group").agg(F.first("image").alias("image"), first("brochure").alias("brochure"), first("floorplan").alias("floorplan"))
    return g.fillna("", ["image", "brochure", "floorplan"])


def attach_groups(listings: DataFrame, items: DataFrame) -> DataFrame:
    """The k-th group to the k-th listing."""
    return matching.zip_by_order(listings, button_groups(items), DOC, "ordinal", "group").drop("group").fillna("", ["image", "brochure", "floorplan"])


def plans_after_links(items: DataFrame) -> DataFrame:
    """(doc_id, pos, url, plan): for each labelled link the next image, unless another labelled link comes first."""
    named = (F.col("kind") == "link") & (F.trim("text") != "")
    d = matching.as_of_forward(items, F.col("kind") == "image", named, F.col("url"), "plan", DOC, POS)
    return d.filter(named).select("doc_id", "pos", "url", "plan")


def card_assets(items: DataFrame, within: int = 3) -> DataFrame:
    """(doc_id, card, brochure, photo): brochure links in order, each with the nearest image at most `within` places away."""
    d = items.withColumn("is_brochure", (F.col("kind") == "link") & F.lower("text").contains("brochure"))
    d = matching.nearest_within(d, (F.col("kind") == "image") & real_image(F.col("text"), F.col("url")), F.col("url"), "photo", DOC, POS, within)
    d = d.filter("is_brochure").withColumn("card", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    return d.select("doc_id", "card", F.col("url").alias("brochure"), F.coalesce("photo", F.lit("")).alias("photo"))


def photo_by_name(items: DataFrame, names: DataFrame, within: int = 6) -> DataFrame:
    """(doc_id, building, photo): the image nearest to a link that is a building's name. names: doc_id, building."""
    d = matching.nearest_within(items, (F.col("kind") == "image") & real_image(F.col("text"), F.col("url")), F.struct("pos", "url"), "near", DOC, POS, within)
    d = d.withColumn("key", text.match_norm(F.col("text"))).filter("near is not null and kind = 'link'")
    hit = names.withColumn("key", text.match_norm(F.col("building"))).join(d.select("doc_id", "key", "pos", "near"), ["doc_id", "key"])
    return hit.groupBy("doc_id", "building").agg(F.min_by("near.url", F.struct(F.abs(F.col("pos") - F.col("near.pos")), "pos")).alias("photo"))


def link_by_name(items: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, building, link): the first link whose label is the building's name."""
    d = items.filter("kind = 'link'").withColumn("key", text.match_norm(F.col("text")))
    hit = names.withColumn("key", text.match_norm(F.col("building"))).join(d.select("doc_id", "key", "pos", "url"), ["doc_id", "key"])
    return hit.groupBy("doc_id", "building").agg(F.min_by("url", "pos").alias("link"))


def image_segments(items: DataFrame) -> DataFrame:
    """(doc_id, segment_no, images, plan, brochure): a segment begins at each real image that follows a link or the beginning."""
    d = items.withColumn("real", (F.col("kind") == "image") & real_image(F.col("text"), F.col("url")))
    before = F.lag("real").over(Window.partitionBy("doc_id").orderBy("pos"))
    d = sequence.islands(d.withColumn("b", F.coalesce(before, F.lit(False))), F.col("real") & ~F.col("b"), "segment_no", DOC, POS).filter("segment_no > 0")
    kind = F.when(F.col("kind") == "link", link_kind(F.col("text"), F.col("url")))
    first = lambda w: F.coalesce(F.min_by(F.when(kind == w, F.col("url")), F.when(kind == w, F.col("pos"))), F.lit(""))
    images = F.transform(F.sort_array(F.collect_list(F.when(F.col("real"), F.struct("pos", "url")))), lambda s: s["url"])
    return d.groupBy("doc_id", "segment_no").agg(images.alias("images"), first("floorplan").alias("plan"), first("brochure").alias("brochure"))


def attach_segments(listings: DataFrame, items: DataFrame) -> DataFrame:
    """Segments to buildings in order: the k-th run of equal buildings takes the k-th segment."""
    return matching.zip_islands(listings, "building", image_segments(items), DOC, "ordinal")


def block_links(listings: DataFrame, links: DataFrame) -> DataFrame:
    """Links of a sheet's rows to the listings of the block that they are in. listings: doc_id, sheet_name, ordinal, address_row, end_row; links: doc_id,
    sheet_name, row_number, url."""
    hit = matching.range_join(links, listings.select("doc_id", "sheet_name", "ordinal", "address_row", "end_row"), ["doc_id", "sheet_name"], "row_number", "address_row", "end_row", 1000)
    return hit.groupBy("doc_id", "ordinal").agg(F.transform(F.sort_array(F.collect_set(F.struct("row_number", "url"))), lambda s: s["url"]).alias("links"))


def row_links(listings: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, ordinal, row_number): first rows of the listing's area with its building and floor, then, for those left, rows with its building; each
    row once. listings: doc_id, ordinal, area, building, floor_unit; links: doc_id, sheet_name, row_number, row_text."""
    d = listings.join(links, "doc_id").filter(F.contains(text.match_norm(F.col("row_text")), text.match_norm(F.col("building"))) & (F.col("building") != ""))
    floor = text.floor_token(F.col("floor_unit"))
    strict = (F.lower("area") == F.lower("sheet_name")) & (floor != "") & (floor == text.floor_token(F.col("row_text")))
    def once(x: DataFrame) -> DataFrame:
        x = x.withColumn("_a", F.row_number().over(Window.partitionBy("doc_id", "ordinal").orderBy("row_number"))).filter("_a = 1")
        return x.withColumn("_b", F.row_number().over(Window.partitionBy("doc_id", "row_number").orderBy("ordinal"))).filter("_b = 1").select("doc_id", "ordinal", "row_number")

    one = once(d.filter(strict))
    rest = d.join(one.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti").join(one.select("doc_id", "row_number"), ["doc_id", "row_number"], "left_anti")
    k = F.row_number().over(Window.partitionBy("doc_id", "building").orderBy("row_number"))
    rows = rest.select("doc_id", "building", "row_number").distinct().withColumn("_k", k)
    wanting = rest.select("doc_id", "building", "ordinal").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "building").orderBy("ordinal")))
    return one.unionByName(once(wanting.join(rows, ["doc_id", "building", "_k"]).select("doc_id", "ordinal", "row_number")))

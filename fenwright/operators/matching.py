"""Joins that are not plain equi-joins. Each has an equality key, so none becomes a nested loop over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import ordered


def as_of_backward(events: DataFrame, is_source: Column, value: Column, name: str, key: list[str], order: list[str]) -> DataFrame:
    """For each row the value of the last source row at or before it: one sort, no join."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.last(F.when(is_source, value), ignorenulls=True).over(w))


def as_of_forward(events: DataFrame, is_source: Column, is_barrier: Column, value: Column, name: str, key: list[str], order: list[str]) -> DataFrame:
    """For each row the value of the next source row, unless a barrier row comes first."""
    w = ordered(key, order).rowsBetween(1, Window.unboundedFollowing)
    nearest = F.first(F.when(is_source | is_barrier, F.struct(is_source.alias("ok"), value.alias("value"))), ignorenulls=True).over(w)
    return events.withColumn(name, F.when(nearest["ok"], nearest["value"]))


def nearest_within(events: DataFrame, is_source: Column, value: Column, name: str, key: list[str], order: list[str], rows: int) -> DataFrame:
    """The value of the nearest source row within `rows` places on either side; of two equally near ones the earlier."""
    w = ordered(key, order)
    at = F.row_number().over(w)
    df = events.withColumn("_at", at)
    item = F.when(is_source, F.struct("_at", value.alias("value")))
    before = F.last(item, ignorenulls=True).over(w.rowsBetween(-rows, -1))
    after = F.first(item, ignorenulls=True).over(w.rowsBetween(1, rows))
    df = df.withColumn("_b", before).withColumn("_a", after)
    b, a = F.col("_at") - F.col("_b._at"), F.col("_a._at") - F.col("_at")
    return df.withColumn(name, F.when(F.col("_a").isNull() | (b <= a), F.col("_b.value")).otherwise(F.col("_a.value"))).drop("_at", "_b", "_a")


def range_join(points: DataFrame, ranges: DataFrame, key: list[str], at: str, begin: str, end: str, bin_size: int) -> DataFrame:
    """Points within [begin, end) of ranges of the same key. Ranges are dealt to bins of the axis, so the join is an equi-join
    on key and bin and a long range or a busy key is spread."""
    p = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(begin) / bin_size), F.floor((F.col(end) - 1) / bin_size))))
    return p.join(r, [*key, "_bin"]).filter((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_bin")


def two_pass(left: DataFrame, right: DataFrame, strict: list[str], relaxed: list[str], left_key: list[str], value: str, order: str) -> DataFrame:
    """Each left row takes the first right row with the strict key; those that find none take the first with the relaxed key."""
    def first(keys: list[str], tag: str) -> DataFrame:
        return right.groupBy(*keys).agg(F.min_by(value, F.struct(order, value)).alias(value)).withColumn("pass", F.lit(tag))

    one = left.join(first(strict, "strict"), strict, "left")
    rest = one.filter(F.col("pass").isNull()).drop(value, "pass")
    return one.filter(F.col("pass").isNotNull()).unionByName(rest.join(first(relaxed, "relaxed"), relaxed, "left"))


def tiered(candidates: DataFrame, key: list[str], tier: str) -> DataFrame:
    """The candidates of the lowest tier of each key."""
    return candidates.withColumn("_t", F.min(tier).over(Window.partitionBy(*key))).filter(F.col(tier) == F.col("_t")).drop("_t")


def all_tiers(candidates: DataFrame, key: list[str], value: str) -> DataFrame:
    """What the candidates of any tier give, each value once."""
    return candidates.select(*key, value).distinct()


def overlap(a: Column, b: Column) -> Column:
    """The area that two rectangles (x0, y0, x1, y1) share, as a part of the area that they cover together."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    shared = side("x0", "x1") * side("y0", "y1")
    return F.when(shared > 0, shared / (area(a) + area(b) - shared)).otherwise(F.lit(0.0))


def _cells(low: Column, high: Column, spread: bool) -> Column:
    """Where a side lies on an axis: (s, c), the power of two of its length and the cell of such a size that its middle is in; or, spread, all
    cells that it touches, of sizes half and twice as large too."""
    size = F.floor(F.log2(F.greatest(high - low, F.lit(1e-9)))).cast("int")
    at = lambda x, s: F.floor(x / F.pow(F.lit(2.0), s.cast("double")))
    if not spread:
        return F.array(F.struct(size.alias("s"), at((low + high) / 2, size).alias("c")))
    touched = lambda s: F.transform(F.sequence(at(low, s), at(high, s)), lambda c: F.struct(s.alias("s"), c.alias("c")))
    return F.flatten(F.array(*[touched(size + d) for d in (-1, 0, 1)]))


def covering(images: DataFrame, links: DataFrame, key: list[str], least: float = 0.5) -> DataFrame:
    """For each image (image_id, box) the last link (link_id, rect, place) of its page that overlaps it by more than `least`, else null.

    With more than half of their area in common, either rectangle holds the other's middle, and their sides differ by a factor of two at
    most: a link is filed by its middle and its size, an image looks in all cells that it touches, of three sizes an axis."""
    if least < 0.5:
        raise ValueError("overlaps of less than a half are not found by the middle")
    sides = lambda df, r, spread: df.withColumn("_x", F.explode(_cells(r["x0"], r["x1"], spread))).withColumn("_y", F.explode(_cells(r["y0"], r["y1"], spread)))
    real = lambda df, r: df.filter((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]))
    a, b = sides(real(images, F.col("box")), F.col("box"), True), sides(real(links, F.col("rect")), F.col("rect"), False)
    met = a.join(b, [*key, "_x", "_y"]).filter(overlap(F.col("box"), F.col("rect")) > least)
    best = met.groupBy(*key, "image_id").agg(F.max_by("link_id", F.struct("place", "link_id")).alias("link_id"))
    return images.select(*key, "image_id").join(best, [*key, "image_id"], "left")


def reading_order(df: DataFrame, key: list[str], x: Column, y: Column, tie: str, name: str = "place") -> DataFrame:
    """Boxes of a page from top to bottom in rows of ten, then from left to right."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(F.bround(y / 10) * 10, x, tie)))


def consume_once(records: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Each record, in order, takes the first link of its document that contains its name and was not taken yet. The state
    is one document's, so it is a grouped map over documents.

    records: key, ordinal, name; links: key, row_no, row_text. Gives key, ordinal, row_no (null if none)."""

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = [(int(n), " ".join(str(t).lower().split())) for n, t in sorted(zip(right["row_no"], right["row_text"], strict=True))]
        rows = []
        for k, ordinal, name in sorted(zip(left[key], left["ordinal"], left["name"], strict=True), key=lambda r: r[1]):
            wanted = " ".join(str(name or "").lower().split())
            hit = next((i for i, (_, t) in enumerate(free) if wanted and wanted in t), None)
            rows.append((k, ordinal, free.pop(hit)[0] if hit is not None else None))
        return pd.DataFrame(rows, columns=[key, "ordinal", "row_no"]).astype({"row_no": "Int64"})

    kind = records.schema[key].dataType.simpleString()
    return records.groupBy(key).cogroup(links.groupBy(key)).applyInPandas(match, f"{key} {kind}, ordinal int, row_no long")


def zip_by_order(left: DataFrame, right: DataFrame, key: list[str], left_order: str, right_order: str) -> DataFrame:
    """The k-th left row of a key with its k-th right row."""
    a = left.withColumn("_k", F.row_number().over(ordered(key, [left_order])))
    b = right.withColumn("_k", F.row_number().over(ordered(key, [right_order])))
    return a.join(b, [*key, "_k"], "left").drop("_k")


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str, version: int) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): entries of another version, or weak ones where the caller is not confident, are misses."""
    good = cache.filter(F.col("logic_version") == version)
    hits = wanted.join(good, key).filter(F.col("confident") | ~F.col("low_confidence"))
    return hits, wanted.join(hits.select(key).distinct(), key, "left_anti")


def nearest_above(images: DataFrame, headings: DataFrame, key: list[str], cell: float = 50.0) -> DataFrame:
    """For each image (image_id, box) the heading (heading_id, head) of its page that ends above it, overlaps it sideways and is the lowest of
    those; of equally low ones the greater id. Images without one have null. Both are dealt to strips of the page, `cell` wide."""
    strips = lambda df, box: df.withColumn("_s", F.explode(F.sequence(F.floor(F.col(f"{box}.x0") / cell), F.floor(F.col(f"{box}.x1") / cell))))
    d = strips(images, "box").join(strips(headings, "head"), [*key, "_s"])
    above = (F.col("head.y1") <= F.col("box.y0")) & (F.col("head.x0") < F.col("box.x1")) & (F.col("head.x1") > F.col("box.x0"))
    best = d.filter(above).groupBy(*key, "image_id").agg(F.max_by("heading_id", F.struct("head.y1", "heading_id")).alias("heading_id"))
    return images.select(*key, "image_id").join(best, [*key, "image_id"], "left")


def spread(rows: DataFrame, slots: DataFrame, key: str, order: str, count: str) -> DataFrame:
    """The k-th row of a key takes its k-th occurrence slot; slots: key, page and how often the key occurs there. Rows beyond the slots have
    no page."""
    one = slots.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
    one = one.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("page", "_i"))).select(key, "page", "_k")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).join(one, [key, "_k"], "left").drop("_k")


def zip_islands(rows: DataFrame, value: str, segments: DataFrame, key: list[str], order: str) -> DataFrame:
    """Runs of equal neighbouring values, numbered from 1, with the segment of that number. segments: key, segment_no, item."""
    w = ordered(key, [order])
    before = F.lag(value).over(w)
    starts = F.coalesce(F.col(value) != before, F.lit(True))
    d = rows.withColumn("_s", starts).withColumn("segment_no", F.sum(F.when(F.col("_s"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.drop("_s").join(segments, [*key, "segment_no"], "left")


def nested_note(rows: DataFrame, notes: DataFrame, key: list[str], group: str, item: str) -> DataFrame:
    """The first note of the row's document whose group is part of the row's, and whose item is part of the row's item. notes: key, g, i, note,
    ordinal."""
    hit = F.contains(F.lower(F.col(group)), F.lower(F.col("g"))) & F.contains(F.lower(F.col(item)), F.lower(F.col("i"))) & (F.col("g") != "")
    best = rows.select(*key, group, item).distinct().join(notes, key).filter(hit).groupBy(*key, group, item).agg(F.min_by("note", "ordinal").alias("note"))
    return rows.join(best, [*key, group, item], "left").withColumn("note", F.coalesce("note", F.lit("")))


def invalidated(cache: DataFrame, key: str, part: str, dry_run: bool = False) -> DataFrame:
    """The cache without the entries whose key has the part; in a dry run those entries."""
    hit = F.contains(F.lower(F.col(key)), F.lit(part.lower()))
    return cache.filter(hit) if dry_run else cache.filter(~hit)

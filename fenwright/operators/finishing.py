"""What is done to listings when their media are known: documents out of photo fields, seeds for blank brochures, which listings need photos
most; and the contacts that an e-mail names at its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import sequence

#: What a line that is a person's name, an e-mail address or a phone number looks like (fixed values).
NAME_LINE = r"^[A-Z][a-zA-Z'.-]+(?: [A-Z][a-zA-Z'.-]+)+$"
EMAIL_LINE = r"^[\w.+-]+@[\w.-]+\.\w+$"
PHONE_LINE = r"^0[0-9]{3,4}[\s-]?[0-9]{3,4}[\s-]?[0-9]{3,4}$"
WRAPPED_PHONE = r"\+?[0-9][0-9\s()]{7,}[0-9]"
#: Parsers whose PDF source is itself a brochure, and how many photos a listing should have (fixed values).
BROCHURE_SOURCES = ["summary grid", "brochure text"]
PHOTO_TARGET = 5
CLEARED = {"high_res_url": "HIGH_RES_DOCUMENT_PLACEHOLDER_CLEARED", "floor_plan_url": "FLOOR_PLAN_DOCUMENT_PLACEHOLDER_CLEARED"}


def usable_plan(plan: Column) -> Column:
    """A plan that is a picture; empty for documents and viewers."""
    p = F.trim(F.coalesce(plan, F.lit("")))
    return F.when(urls.is_viewer(p), F.lit("")).otherwise(p)


def clear_documents(listings: DataFrame) -> DataFrame:
    """Photo and plan fields without addresses of documents, and `cleared`, an array of (code, original_url) of what went."""
    h, p = (F.trim(F.coalesce(c, F.lit(""))) for c in ("high_res_url", "floor_plan_url"))
    gone = {"high_res_url": (h != "") & urls.must_leave_photos(h), "floor_plan_url": (p != "") & (urls.must_leave_photos(p) | urls.is_viewer(p))}
    was = {"high_res_url": h, "floor_plan_url": p}
    notes = F.array(*[F.when(gone[c], F.struct(F.lit(code).alias("code"), was[c].alias("original_url"))) for c, code in CLEARED.items()])
    d = listings.withColumn("cleared", F.filter(notes, lambda n: n.isNotNull()))
    return d.withColumns({c: F.when(gone[c], F.lit("")).otherwise(F.col(c)) for c in gone})


def seed_brochures(listings: DataFrame, files: DataFrame) -> DataFrame:
    """Blank brochures of listings from a PDF that is a brochure itself take its address: one read by a model or by a parser of brochures, one that is
    called a brochure, or one about a single building. files: doc_id, filename, method, source_url."""
    one = F.count_distinct(F.nullif(F.lower(F.trim("building")), F.lit(""))) == 1
    about = listings.groupBy("doc_id").agg(one.alias("one_building")).join(files.select("doc_id", "filename", "method", "source_url"), "doc_id")
    is_brochure = F.col("method").startswith("model") | F.col("method").isin(*BROCHURE_SOURCES) | F.lower("filename").contains("brochure") | F.col("one_building")
    seeds = about.filter(F.lower("filename").endswith(".pdf") & (F.coalesce("source_url", F.lit("")) != "") & is_brochure).select("doc_id", F.col("source_url").alias("_seed"))
    blank = F.trim(F.coalesce("brochure_url", F.lit(""))) == ""
    return listings.join(seeds, "doc_id", "left").withColumn("brochure_url", F.when(blank & F.col("_seed").isNotNull(), F.col("_seed")).otherwise(F.col("brochure_url"))).drop("_seed")


def photo_need(high_res: Column, candidates: Column) -> Column:
    """How much a listing needs photos: 0 it has none, 1 fewer than the target, 2 enough. Documents and pages are no photos, and addresses that differ
    in their query are one."""
    own = F.when(F.lower(high_res).contains(".html"), F.lit("")).otherwise(F.trim(F.coalesce(high_res, F.lit(""))))
    photos = F.filter(F.concat(F.array(own), F.coalesce(candidates, F.array().cast("array<string>"))), lambda u: (F.coalesce(u, F.lit("")) != "") & ~urls.is_document_seed(u))
    n = F.size(F.array_distinct(F.transform(photos, lambda u: F.regexp_extract(u, r"(?s)^([^?]*)", 1))))
    return F.when(n == 0, 0).when(n < PHOTO_TARGET, 1).otherwise(2)


def in_need_order(seeds: DataFrame, url: str, need: str, ordinal: str) -> DataFrame:
    """(url, need, first, place): each address once, with the greatest need among its listings; the neediest first, then the first to name it."""
    g = seeds.groupBy(url).agg(F.min(need).alias("need"), F.min(ordinal).alias("first"))
    # Needs have three values, so ranks are counted within each and shifted by the sizes of those before: no window holds all rows but one of a need.
    sizes = g.groupBy("need").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("need"), F.coalesce(F.sum("n").over(Window.orderBy("need").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return g.join(F.broadcast(before), "need").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("need").orderBy("first", url))).drop("before")


def plans_first(assets: DataFrame, key: list[str], ordinal: str, name: str = "place") -> DataFrame:
    """Assets in the order in which they are stored: plans before all else, so that no limit on photos costs a plan."""
    return assets.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(F.when(F.col("class") == "floorplan", 0).otherwise(1), ordinal)))


def extra_seeds(primary: Column, others: Column) -> Column:
    """Further addresses to look up, in order and each once: not the primary one in another form, and none of a low-trust host."""
    usable = F.filter(others, lambda u: (urls.canonical(u) != "") & ~urls.is_low_trust(u) & (urls.canonical(u) != urls.canonical(F.coalesce(primary, F.lit("")))))
    seen = lambda a: F.filter(a, lambda u, i: F.array_position(F.transform(a, lambda x: urls.canonical(x)), urls.canonical(u)) == i + 1)
    return F.get(F.transform(F.array(usable), seen), F.lit(0))


def merge_dashes(lines: DataFrame, key: list[str], at: str, line: str) -> DataFrame:
    """Lines of which one that is only a dash is put before the next one. In a run of dashes the first takes the second, the third the fourth."""
    w = Window.partitionBy(*key).orderBy(at)
    dash = F.col(line) == "-"
    d = lines.withColumn("_run", F.sum(F.when(dash, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.when(dash, F.row_number().over(Window.partitionBy(*key, "_run", F.when(dash, 1).otherwise(0)).orderBy(at)))
    d = d.withColumn("_next", F.lead(line).over(w)).withColumn("_takes", dash & (place % 2 == 1) & F.col("_next").isNotNull())
    taken = F.coalesce(F.lag("_takes").over(w), F.lit(False))
    return d.withColumn("_taken", taken).filter("not _taken").withColumn(line, F.when(F.col("_takes"), F.concat(F.lit("- "), F.col("_next"))).otherwise(F.col(line))).drop("_run", "_next", "_takes", "_taken")


def _block(lines: DataFrame, begin: Column, end: Column) -> DataFrame:
    """The lines behind the first `begin` line of a document up to the first `end` line after it, with their place i from 0. lines: doc_id, at, line."""
    w = Window.partitionBy("doc_id")
    d = lines.withColumn("_b", F.min(F.when(begin, F.col("at"))).over(w)).filter("at > _b")
    d = d.withColumn("_e", F.min(F.when(end, F.col("at"))).over(w)).filter("_e is null or at < _e")
    return d.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).drop("_b", "_e")


def _joined(d: DataFrame) -> DataFrame:
    """(doc_id, contacts) of (doc_id, i, name, more): each name once, the first with what belongs to it."""
    once = sequence.first_seen(d, [F.col("doc_id"), F.col("name")], ["i"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat(F.array("name"), F.filter("more", lambda m: m != "")).alias("p")))), lambda s: s["p"])
    return once.groupBy("doc_id").agg(F.array_join(F.flatten(parts), ", ").alias("contacts"))


def contacts_by_website(lines: DataFrame) -> DataFrame:
    """(doc_id, contacts): in the block behind `Contact`, each website line has a name four lines before it, a phone two and an e-mail one."""
    d = _block(lines, F.col("line") == "Contact", F.lower("line").startswith("copyright"))
    w = Window.partitionBy("doc_id").orderBy("i")
    d = d.withColumns({f"b{k}": F.lag("line", k).over(w) for k in (1, 2, 4)}).filter(F.lower("line").startswith("www.") & (F.col("i") >= 4) & F.col("b4").rlike(NAME_LINE))
    more = F.array(F.when(F.col("b1").rlike(EMAIL_LINE), F.col("b1")).otherwise(""), F.when(F.col("b2").rlike(PHONE_LINE), F.col("b2")).otherwise(""))
    return _joined(d.select("doc_id", "i", F.col("b4").alias("name"), more.alias("more")))


def contacts_by_name(lines: DataFrame) -> DataFrame:
    """(doc_id, contacts): in the block behind `Get in touch`, each name has the phone that the lines up to the next name make together."""
    d = _block(lines, F.col("line") == "Get in touch", F.col("line") == "View in browser").withColumn("is_name", F.col("line").rlike(NAME_LINE))
    d = sequence.islands(d, F.col("is_name"), "part", ["doc_id"], ["i"]).filter("part > 0")
    g = d.groupBy("doc_id", "part").agg(
        F.min("i").alias("i"), F.min_by("line", "i").alias("name"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_name"), F.struct("i", "line")))), lambda s: s["line"]), "").alias("rest"),
    )
    return _joined(g.select("doc_id", "i", "name", F.array(F.trim(F.regexp_extract("rest", f"({WRAPPED_PHONE})", 1))).alias("more")))

"""Layout parsers: ordered lines or table rows in, raw listings out.

Every parser takes DataFrames keyed by doc_id and returns the columns of RAW; `dispatch` keeps, for each document, the rows of the
first parser whose rows are plausible. Nothing loops over lines: sections are islands, fields are offsets and bounded looks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from . import sequence, tables

RAW = ["doc_id", "ordinal", "area", "building", "floor_unit", "size", "desks", "price_pcm", "price_psf", "sale_price", "features", "contacts"]
AREA = r"^[A-Z][A-Z '\"]+$"
FLOOR = r"(?i)^(lower ground|ground|basement|mezzanine|[0-9]{1,2}(st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b.*(floor)?"
#: The four lines above each table of the marker layout (fixed values).
MARKER = ["Available", "Desk space", "Sq ft", "Price (psf)"]
DOC = ["doc_id"]


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at, line): trimmed lines that are not empty, numbered."""
    d = sequence.text_lines(docs).withColumn("line", F.trim("line")).filter("line <> ''")
    return d.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).select("doc_id", "at", "line")


def raw(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns of RAW; those not given are empty."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    given = {"ordinal": order, **columns}
    return df.select("doc_id", *[F.coalesce(given[c].cast("int" if c == "ordinal" else "string"), F.lit(0 if c == "ordinal" else "")).alias(c) if c in given else F.lit("").alias(c) for c in RAW[1:]])


def _near(k: int) -> Column:
    w = Window.partitionBy("doc_id").orderBy("at")
    return F.coalesce(F.lead("line", k).over(w) if k > 0 else F.lag("line", -k).over(w), F.lit(""))


def _after_label(d: DataFrame, label: str, name: str, rows: int = 25) -> DataFrame:
    """The line behind the first line with the label within the next rows."""
    return sequence.look_ahead(d, F.when(F.col("line") == label, F.col("next")), name, DOC, ["at"], rows - 1, 0)


def button_cards(docs: DataFrame) -> DataFrame:
    """A listing at each `Available` line: two lines on the floor, then labelled values within 25 lines. A new building stands in the
    two lines before, and its address is repeated three lines on."""
    d = clean_lines(docs)
    d = d.withColumns({"next": _near(1), "b2": _near(-2), "b1": _near(-1), "f1": _near(1), "f2": _near(2), "f3": _near(3)})
    has_code = lambda c: F.col(c).rlike(r"\b[A-Z]{1,2}[0-9][A-Z0-9]?( [0-9][A-Z]{2})?\b")
    starts = (F.col("line") == "Available") | F.col("line").startswith("Available from")
    fresh = starts & (F.col("b1") != "") & (F.col("b1") == F.col("f3")) & ~F.col("b2").startswith("Available")
    is_area = F.col("line").rlike(AREA) & (F.size(F.split("line", " ")) <= 3) & (has_code("f2") | has_code("f1"))
    d = sequence.carry_forward(d, F.when(is_area, F.initcap("line")), "area", DOC, ["at"])
    d = sequence.carry_forward(d, F.when(fresh, text.combine_name_address(F.col("b2"), F.col("b1"))), "building", DOC, ["at"])
    for label, name in (("Seats", "seats"), ("Size", "size"), ("Price (monthly)", "pcm"), ("Price (per sqft)", "psf")):
        d = _after_label(d, label, name)
    number = lambda c: F.regexp_replace(F.col(c), "(?i)[£,]|sqft|pcm|per", "")
    d = d.filter(starts)
    return raw(d, area=F.col("area"), building=F.col("building"), floor_unit=F.col("f2"), size=F.trim(number("size")), desks=F.col("seats"), price_pcm=F.trim(number("pcm")), price_psf=F.trim(number("psf")))


def labelled_lines(docs: DataFrame) -> DataFrame:
    """A listing at each `Sqft:` line; desks and price follow. Before it stand the area (capitals), the name, a remark in brackets and
    the floor behind a dash."""
    d = clean_lines(docs).withColumns({"f1": _near(1), "f2": _near(2)})
    starts = F.lower("line").startswith("sqft:")
    # Lines up to and with a Sqft line are its block; the three lines behind it belong to none.
    d = d.withColumn("is_start", starts)
    d = sequence.look_back(d, F.when(F.col("is_start"), F.col("at")), "last_start", DOC, ["at"], 3)
    d = d.filter(F.col("last_start").isNull())
    w = Window.partitionBy("doc_id").orderBy("at")
    d = d.withColumn("block", F.coalesce(F.sum(F.when(F.col("is_start"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    is_area = F.col("line").rlike(AREA) & (F.size(F.split("line", " ")) <= 3)
    last_area = F.max(F.when(is_area, F.struct("at", F.initcap("line").alias("area")))).over(Window.partitionBy("doc_id", "block"))
    d = d.withColumn("in_block", last_area)
    d = d.withColumn("part", F.when(F.col("is_start"), "start").when(F.col("in_block").isNotNull() & (F.col("at") <= F.col("in_block.at")), "head").when(F.col("line").startswith("-"), "floor").otherwise("name"))
    g = d.groupBy("doc_id", "block").agg(
        F.max(F.when(F.col("part") == "start", F.struct("at", "line", "f1", "f2"))).alias("s"),
        F.max("in_block.area").alias("own_area"),
        F.max(F.when(F.col("part") == "floor", F.struct("at", "line")))["line"].alias("floor"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == "name", F.struct("at", "line")))), lambda x: x["line"]), " ").alias("building"),
    )
    g = sequence.carry_forward(g, F.col("own_area"), "area", DOC, ["block"]).filter("s is not null and building <> ''").withColumn("at", F.col("s.at"))
    value = lambda c, label: F.when(F.lower(c).startswith(label), F.trim(F.regexp_replace(c, "^[^:]*:", ""))).otherwise("")
    desks = value(F.col("s.f1"), "desks:")
    return raw(
        g, area=F.col("area"), building=F.col("building"), floor_unit=F.trim(F.regexp_replace("floor", "^[- ]+", "")), size=F.regexp_replace(value(F.col("s.line"), "sqft:"), ",", ""),
        desks=numbers.desks(desks), price_pcm=F.regexp_replace(value(F.col("s.f2"), "price:"), "[£,]", ""), features=desks,
    )


def address_cards(docs: DataFrame) -> DataFrame:
    """Address lines (with a postcode) begin buildings, floor lines begin listings; desks and price are in the lines up to the next."""
    d = clean_lines(docs)
    d = d.withColumn("is_address", F.col("line").rlike(r"^.*[A-Za-z].*,? [A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}$"))
    d = d.withColumn("is_floor", ~F.col("is_address") & F.col("line").rlike(FLOOR) & F.lower("line").contains("floor"))
    d = sequence.islands(d, F.col("is_address") | F.col("is_floor"), "part", DOC, ["at"])
    d = sequence.carry_forward(d, F.when(F.col("is_address"), F.col("line")), "building", DOC, ["at"])
    desks, price = r"(?i)^([0-9]+) +desks?\b", r"(?i)£ *([0-9,]+) *per month"
    g = d.filter("building is not null").groupBy("doc_id", "part").agg(
        F.max(F.when(F.col("is_floor"), F.struct("at", "line", "building"))).alias("f"),
        F.min(F.when(F.col("line").rlike(desks), F.struct("at", "line")))["line"].alias("d"),
        F.min(F.when(F.col("line").rlike(price), F.struct("at", "line")))["line"].alias("p"),
    ).filter("f is not null").withColumn("at", F.col("f.at"))
    return raw(g, building=F.col("f.building"), floor_unit=F.col("f.line"), desks=F.regexp_extract("d", desks, 1), price_pcm=F.regexp_replace(F.regexp_extract("p", price, 1), ",", ""), features=F.col("d"))


def marker_tables(docs: DataFrame) -> DataFrame:
    """Four marker lines, then tuples of four lines: floor, desks, size, price. At most two other lines stand before the first tuple. The
    upper bound of a range counts."""
    d = clean_lines(docs)
    begin = F.max(F.when(F.col("line") == "CURRENT AVAILABILITY", F.col("at"))).over(Window.partitionBy("doc_id"))
    d = d.withColumn("begin", F.coalesce(begin, F.lit(-1))).filter("at > begin")
    d = d.withColumns({f"f{k}": _near(k) for k in (1, 2, 3)})
    is_marker = (F.col("line") == MARKER[0]) & (F.col("f1") == MARKER[1]) & (F.col("f2") == MARKER[2]) & (F.col("f3") == MARKER[3])
    d = sequence.carry_forward(d.withColumn("m", is_marker), F.when(is_marker, F.col("at")), "marker", DOC, ["at"])
    tuple_ok = F.col("f1").rlike(r"(?i)\bdesks?\b") & F.col("f2").rlike(r"^[0-9,]+( *- *[0-9,]+)?$") & F.col("f3").rlike(r"^£[0-9,.]+( *- *£?[0-9,.]+)?$")
    d = d.withColumn("ok", tuple_ok & F.col("marker").isNotNull() & (F.col("at") >= F.col("marker") + 4))
    first = F.min(F.when(F.col("ok"), F.col("at"))).over(Window.partitionBy("doc_id", "marker"))
    d = d.withColumn("first", first).withColumn("on_grid", F.col("ok") & (F.col("first") <= F.col("marker") + 6) & ((F.col("at") - F.col("first")) % 4 == 0))
    # A run of tuples ends at the first gap: the k-th must stand 4k lines below the first.
    k = F.sum(F.when(F.col("on_grid"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "marker").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("hit", F.col("on_grid") & (F.col("at") == F.col("first") + 4 * F.coalesce(k, F.lit(0))))
    # What is neither marker nor tuple stands above the next marker: its name, area and dashed features.
    covered = F.coalesce(F.max(F.when(F.col("hit") | F.col("m"), F.col("at"))).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(-3, 0)), F.lit(-9))
    d = d.withColumn("free", F.col("at") - covered > 3).withColumn("is_area", F.col("free") & F.col("line").rlike(AREA) & (F.size(F.split("line", " ")) <= 4))
    nxt = F.first(F.when(F.col("m"), F.col("at")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("for_marker", F.when(F.col("free"), nxt))
    last_area = F.max(F.when(F.col("is_area"), F.col("at"))).over(Window.partitionBy("doc_id", "for_marker"))
    head = d.filter("for_marker is not null").withColumn("area_at", F.coalesce(last_area, F.lit(-1))).groupBy("doc_id", F.col("for_marker").alias("marker")).agg(
        F.max(F.when(F.col("at") == F.col("area_at"), F.initcap("line"))).alias("own_area"),
        F.min(F.when(F.col("at") > F.col("area_at"), F.struct("at", "line")))["line"].alias("building"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("at") > F.col("area_at")) & F.col("line").startswith("-"), F.struct("at", F.trim(F.regexp_replace("line", "^[- ]+", "")).alias("line"))))), lambda x: x["line"]), "; ").alias("features"),
    )
    head = sequence.carry_forward(head, F.col("own_area"), "area", DOC, ["marker"])
    upper = lambda c: F.trim(F.element_at(F.split(F.regexp_replace(c, "[£,]", ""), "-"), -1))
    rows = d.filter("hit").join(head, ["doc_id", "marker"], "left")
    return raw(rows, area=F.col("area"), building=F.col("building"), floor_unit=F.col("line"), size=upper(F.col("f2")), desks=numbers.desks(F.col("f1")), price_psf=upper(F.col("f3")), features=F.col("features"))


def brochure_text(docs: DataFrame) -> DataFrame:
    """A listing at each `Proposed space` line: unit and size, desks, price and deposit in the four lines behind. The building is three lines
    of name, street and postcode."""
    d = clean_lines(docs).withColumns({f"f{k}": _near(k) for k in (1, 2, 3, 4)})
    code = r"^(?:London,? )?([A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2})$"
    name = F.when(F.col("f2").rlike(code) & F.col("f1").rlike("^[0-9]"), F.concat(F.col("line"), F.lit(", "), F.col("f1"), F.lit(", London "), F.regexp_extract("f2", code, 1)))
    contact = F.when(F.col("line").rlike("(?i)^contact: "), F.regexp_replace("line", "(?i)^contact: *", ""))
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("building", F.first(name, ignorenulls=True).over(w)).withColumn("contact", F.first(contact, ignorenulls=True).over(w))
    unit = r"(?i)^(.*?)[ ,:–-]+([0-9][0-9,]*) *sq\.? ?ft"
    d = d.filter((F.lower("line") == "proposed space") & F.col("building").isNotNull() & F.col("f1").rlike(unit))
    features = F.concat_ws(". ", F.when(F.col("f2") != "", F.col("f2")), F.when(F.col("f3").rlike(r"(?i)\bvat\b"), F.lit("Price excludes VAT")))
    return raw(d, building=F.col("building"), floor_unit=F.regexp_extract("f1", unit, 1), size=F.regexp_replace(F.regexp_extract("f1", unit, 2), ",", ""), desks=F.regexp_extract("f2", "([0-9]+)", 1), price_pcm=F.regexp_replace(F.regexp_extract("f3", "£ *([0-9,]+)", 1), ",", ""), features=features, contacts=F.col("contact"))


SUMMARY = {"building": ["building"], "floor": ["floor"], "size": ["size"], "desks": ["num of desks"], "price": ["market price"], "sale": ["sale price"], "features": ["includes"]}


def summary_grid(rows: DataFrame) -> DataFrame:
    """A table whose header, anywhere in it, names both the number of desks and a sale price."""
    d = tables.with_header(rows, SUMMARY, 4, ["building", "desks", "sale"], within=1 << 30)
    at = lambda t: tables.cell(F.col("cells"), F.col(f"h.{t}"))
    d = d.withColumn("at", F.struct("table_idx", "row_idx")).filter(at("building") != "")
    return raw(d, building=at("building"), floor_unit=at("floor"), size=at("size"), desks=at("desks"), price_pcm=at("price"), sale_price=at("sale"), features=at("features"))


def _from_tables(rows: DataFrame) -> DataFrame:
    d = rows.withColumn("at", F.struct("table_idx", "row_idx"))
    area = F.col("area") if "area" in rows.columns else F.lit("")
    return raw(d, area=area, building=F.col("building"), floor_unit=F.col("floor"), size=F.col("size"), desks=F.col("desks"), price_pcm=F.col("price"))


@dataclass(frozen=True)
class Parser:
    """detect: whether a document (text, sender, subject) may have the layout; parse: lines from documents or rows from tables."""

    name: str
    detect: Column | None
    parse: Callable[[DataFrame], DataFrame]
    of_tables: bool = False


def parsers() -> list[Parser]:
    blob = F.lower(F.concat_ws(" ", "sender", "subject", "text"))
    return [
        Parser("button cards", blob.contains("price (monthly)"), button_cards),
        Parser("labelled lines", blob.rlike(r"(?m)^\s*sqft:"), labelled_lines),
        Parser("address cards", blob.contains("per month"), address_cards),
        Parser("marker tables", blob.contains("price (psf)"), marker_tables),
        Parser("summary grid", None, summary_grid, True),
        Parser("brochure text", blob.contains("proposed space"), brochure_text),
        Parser("availability sheet", None, lambda r: _from_tables(tables.sheet_listings(r)), True),
        Parser("property blocks", None, lambda r: _from_tables(tables.property_blocks(r)), True),
        Parser("generic grid", None, lambda r: _from_tables(tables.read_grid(r, within=1)), True),
    ]


def dispatch(docs: DataFrame, rows: DataFrame, registry: list[Parser] | None = None) -> DataFrame:
    """Listings with parser and rule_rank: per document those of the first parser that finds plausible rows. docs: doc_id, text, sender,
    subject; rows: doc_id, table_idx, row_idx, cells. A parser sees only documents that its detector lets through."""
    out = None
    for rank, p in enumerate(registry or parsers()):
        found = p.parse(rows) if p.of_tables else p.parse(docs.filter(p.detect))
        found = found.withColumn("parser", F.lit(p.name)).withColumn("rule_rank", F.lit(rank))
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("doc_id", "rule_rank")
    long = F.greatest(*[F.length(c) for c in ("building", "floor_unit", "area", "desks")]) > 200
    noise = F.lower("building").rlike("unsubscribe|view in browser|all rights reserved")
    ok = out.withColumn("plausible", ~F.bool_or(long | noise).over(w)).filter("plausible").drop("plausible")
    return ok.withColumn("_r", F.min("rule_rank").over(Window.partitionBy("doc_id"))).filter("rule_rank = _r").drop("_r")

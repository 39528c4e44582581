"""Tables whose header is found by key words. Rows are (doc_id, table_idx, row_idx, cells)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.address import postcode
from ..functions.text import match_norm, words_only, ws_norm

#: Key words of headers by target (fixed values).
GRID = {"building": ["building", "address", "property"], "floor": ["floor", "unit"], "size": ["sq ft", "size", "area"], "desks": ["desk", "desks"], "price": ["rent", "price", "pcm", "per month"], "term": ["term"], "contact": ["contact"], "brochure": ["brochure"]}
NULLS = ("nan", "none", "click here", "n/a", "-")
TABLE = ["doc_id", "table_idx"]


def header_index(cells: Column, words: list[str], whole: bool = False) -> Column:
    """The first cell (from 0) that holds one of the words, as a part or as a whole word; -1 without one."""
    if whole:
        hit = lambda s: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.concat(F.lit(" "), words_only(s), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" "))))
    else:
        hit = lambda s: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(match_norm(s), w))
    return F.array_position(F.transform(cells, lambda s: hit(s)), F.lit(True)).cast("int") - 1


def header_map(cells: Column, targets: dict[str, list[str]], whole: bool = False) -> Column:
    return F.struct(*[header_index(cells, w, whole).alias(t) for t, w in targets.items()])


def mapped(h: Column, targets: dict[str, list[str]]) -> Column:
    """How many targets a header has."""
    one = [F.when(h[t] >= 0, 1).otherwise(0) for t in targets]
    return sum(one[1:], one[0])


def cell(cells: Column, index: Column) -> Column:
    """A cell's text: empty outside the row and for tokens that mean nothing."""
    t = ws_norm(F.when(index >= 0, F.get(cells, index)))
    return F.when(F.lower(t).isin(*NULLS), F.lit("")).otherwise(t)


def with_header(rows: DataFrame, targets: dict[str, list[str]], least: int, need: list[str], within: int = 20, whole: bool = False) -> DataFrame:
    """Rows below a table's header, with the header's row (header_idx) and map (h). The header is the first of the `within` first
    rows with `least` targets, those in `need` among them."""
    d = rows.withColumn("_h", header_map(F.col("cells"), targets, whole))
    ok = (mapped(F.col("_h"), targets) >= least) & (F.col("row_idx") < within)
    for t in need:
        ok &= F.col("_h")[t] >= 0
    w = Window.partitionBy(*TABLE)
    first = F.min(F.when(ok, F.struct("row_idx", F.col("_h").alias("h"), F.col("cells").alias("header")))).over(w)
    return d.withColumn("_f", first).filter("_f is not null and row_idx > _f.row_idx").withColumns({"header_idx": F.col("_f.row_idx"), "h": F.col("_f.h"), "header": F.col("_f.header")}).drop("_f", "_h")


def read_grid(rows: DataFrame, least: int = 4, whole: bool = False, within: int = 20) -> DataFrame:
    """One row per listing: building, floor, size, desks, price, term, contact, brochure. A row without building and floor is
    none."""
    d = with_header(rows, GRID, least, [], within, whole)
    at = lambda t: cell(F.col("cells"), F.col(f"h.{t}"))
    d = d.select(*TABLE, "row_idx", at("building").alias("building"), at("floor").alias("floor"), numbers.to_number(at("size")).alias("size"), numbers.desks(at("desks")).alias("desks"), numbers.to_number(at("price")).alias("price"), at("term").alias("term"), at("contact").alias("contact"), at("brochure").alias("brochure"))
    return d.filter("building <> '' and (floor <> '' or size is not null)")


def contact_columns(cells: Column, h: Column) -> Column:
    """Columns that no target has, to the right of the last mapped one if there are any there, else all such columns."""
    used = F.array(*[h[t] for t in GRID])
    free = F.array_except(F.sequence(F.lit(0), F.size(cells) - 1), used)
    right = F.filter(free, lambda i: i > F.array_max(used))
    return F.when(F.size(right) > 0, right).otherwise(free)


def building_column(cells: Column, floor: Column, used: Column) -> Column:
    """The nearest non-empty column left of the floor that no target has; -1 without one."""
    left = F.reverse(F.when(floor > 0, F.sequence(F.lit(0), F.greatest(floor, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>")))
    return F.coalesce(F.get(F.filter(left, lambda i: ~F.array_contains(used, i) & (ws_norm(F.get(cells, i)) != "")), F.lit(0)), F.lit(-1))


def sheet_listings(rows: DataFrame) -> DataFrame:
    """An availability sheet: a header with floor and size by whole words; a building column without a heading is inferred."""
    targets = {k: v for k, v in GRID.items()}
    d = with_header(rows, targets, 3, ["floor", "size"], 20, True)
    used = F.array(*[F.col(f"h.{t}") for t in targets])
    own = F.when(F.col("h.building") >= 0, F.col("h.building")).otherwise(building_column(F.col("header"), F.col("h.floor"), used))
    own = F.when(own >= 0, own).otherwise(building_column(F.col("cells"), F.col("h.floor"), used))
    at = lambda t: cell(F.col("cells"), F.col(f"h.{t}"))
    d = d.select(*TABLE, "row_idx", cell(F.col("cells"), own).alias("building"), at("floor").alias("floor"), numbers.to_number(at("size")).alias("size"), numbers.desks(at("desks")).alias("desks"), numbers.to_number(at("price")).alias("price"))
    return d.filter("building <> '' and (floor <> '' or size is not null) and lower(floor) <> 'floor'")


def property_blocks(rows: DataFrame) -> DataFrame:
    """Repeated blocks: a row with an address and postcode, a header at most five rows below, and rows to the next address.
    One row per listing with address_row and end_row, for range joins of links."""
    w = Window.partitionBy(*TABLE).orderBy("row_idx")
    d = rows.withColumn("line", F.array_join(F.col("cells"), " ")).withColumn("is_address", postcode(F.array_join(F.col("cells"), " ")) != "")
    d = d.withColumn("h0", header_map(F.col("cells"), GRID, False)).withColumn("is_header", (mapped(F.col("h0"), GRID) >= 3) & (F.col("h0.floor") >= 0) & ~F.col("is_address"))
    near = F.last(F.when(F.col("is_address"), F.col("row_idx")), ignorenulls=True).over(w.rowsBetween(-5, -1))
    d = d.withColumn("address_of_header", F.when(F.col("is_header"), near))
    last = lambda x: F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = F.first(F.when(F.col("is_address"), F.col("row_idx")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    total = F.max("row_idx").over(Window.partitionBy(*TABLE)) + 1
    d = d.withColumn("block", last(F.when(F.col("is_address"), F.struct(F.col("row_idx").alias("at"), F.col("cells").alias("cells")))))
    d = d.withColumn("head", last(F.when(F.col("address_of_header").isNotNull(), F.struct(F.col("row_idx").alias("at"), F.col("address_of_header").alias("of"), F.col("h0").alias("h"))))).withColumn("end_row", F.coalesce(nxt, total))
    d = d.filter("head is not null and head.of = block.at and row_idx > head.at and not is_address and not is_header")
    at = lambda t: cell(F.col("cells"), F.col(f"head.h.{t}"))
    d = d.select(*TABLE, "row_idx", F.col("block.at").alias("address_row"), "end_row", ws_norm(F.get("block.cells", F.lit(0))).alias("building"), cell(F.col("block.cells"), F.lit(1)).alias("area"), at("floor").alias("floor"), numbers.first_number(at("size")).alias("size"), numbers.desks(at("desks")).alias("desks"), numbers.first_number(at("price")).alias("price"))
    return d.filter("floor <> '' or size is not null")

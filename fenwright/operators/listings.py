"""From raw listings to the fixed schema: derived columns, address tiers, evidence, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address, merge, numbers, text, urls

#: Output columns in order (fixed values): display name, field.
COLUMNS = [
    ("External Ref", "external_ref"), ("Assigned Agents", "assigned_agents"), ("Property Address 1", "property_address_1"), ("Property Postcode", "property_postcode"),
    ("Lat", "lat"), ("Lng", "lng"), ("For Sale", "for_sale"), ("To Let", "to_let"), ("Area", "area"), ("Building", "building"), ("Floor/Unit", "floor_unit"), ("Size (sq ft)", "size_sqft"),
    ("Desks (max)", "desks_max"), ("Marketing Price (Based on Min Term) PCM", "price_pcm"), ("Marketing Price (Based on Min Term) PSF", "price_psf"), ("Brochure PDF", "brochure_url"),
    ("Min. Term", "min_term"), ("Special Features", "special_features"), ("State of Space", "state_of_space"), ("Legal Structure", "legal_structure"), ("Broker Fee", "broker_fee"),
    ("Contacts", "contacts"), ("Floor Plan", "floor_plan_url"), ("High Res Images", "high_res_url"),
]
TEXTS = ["legal_structure", "broker_fee", "brochure_url", "floor_plan_url", "high_res_url", "min_term", "state_of_space"]


def normalize(rows: DataFrame, judged: bool = True) -> DataFrame:
    """Raw listings in the fixed schema; rows with neither building nor area go. Columns that rows lack are blank, extra ones stay. judged: features
    and state of space are cleaned and told apart; a caller that reads neither saves some thousands of expressions, which take seconds to build."""
    d = rows
    for c in TEXTS:
        d = d if c in d.columns else d.withColumn(c, F.lit(""))
    pair = numbers.price_pair(numbers.to_number(F.col("size")), numbers.to_number(F.col("price_pcm")), numbers.to_number(F.col("price_psf")))
    both = text.reclassify(F.col("features"), F.col("state_of_space")) if judged else F.struct("features", F.col("state_of_space").alias("status"))
    d = d.withColumns({"_p": pair, "_f": both, "building": text.ws_norm(F.col("building")), "area": text.titlecase(text.ws_norm(F.col("area")))}).filter("building <> '' or area <> ''")
    agents = text.names_only(F.col("contacts"))
    return d.withColumns(
        {
            "external_ref": F.lit(""), "assigned_agents": F.when(agents == "", "Unknown").otherwise(agents), "property_address_1": F.col("building"), "property_postcode": address.postcode(F.col("building")),
            "postcode_status": F.when(address.postcode(F.col("building")) != "", "source").otherwise(""), "lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double"), "geo_status": F.lit(""),
            "for_sale": text.has_value(F.col("sale_price")), "to_let": F.lit(True), "size_sqft": numbers.to_number(F.col("size")), "desks_max": numbers.to_number(F.col("desks")),
            "price_pcm": F.col("_p.pcm"), "price_psf": F.col("_p.psf"), "min_term": text.min_term(F.col("min_term")), "special_features": F.col("_f.features"), "state_of_space": F.col("_f.status"),
        }
    ).drop("_p", "_f", "size", "desks", "features", "sale_price")


def with_provenance(listings: DataFrame, method: str) -> DataFrame:
    """provenance: for each field that is not empty its source, method, confidence and original value."""
    fields = [f for _, f in COLUMNS if f in listings.columns]
    one = lambda f: F.struct(F.lit("source").alias("source"), F.lit(method).alias("method"), F.lit(1.0).alias("confidence"), F.col(f).cast("string").alias("original_value"))
    m = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[one(f) for f in fields]))
    return listings.withColumn("provenance", F.map_filter(m, lambda _, v: F.coalesce(v["original_value"], F.lit("")) != ""))


def apply_evidence(listings: DataFrame, evidence: DataFrame, fields: list[str], locked: tuple[str, ...] = ("property_postcode", "property_address_1"), primary: float = 0.75) -> DataFrame:
    """Listings with evidence (doc_id, ordinal, field, value, confidence) merged into text fields, and the outcomes by field. The strongest
    evidence of a field counts, the first on ties by value. A listing's own value has the confidence of its provenance, else `primary`."""
    best = evidence.groupBy("doc_id", "ordinal", "field").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", "value")).alias("e"))
    wide = best.groupBy("doc_id", "ordinal").agg(F.map_from_entries(F.collect_list(F.struct("field", "e"))).alias("ev"))
    d = listings.join(wide, ["doc_id", "ordinal"], "left")
    known = (lambda f: F.coalesce(F.try_element_at("provenance", F.lit(f))["confidence"], F.lit(primary))) if "provenance" in listings.columns else (lambda f: F.lit(primary))
    merged = {f"_{f}": merge.merge_value(F.col(f).cast("string"), known(f), F.col("ev")[f]["value"], F.col("ev")[f]["confidence"], f in locked) for f in fields}
    d = d.withColumns(merged)
    kinds = dict(listings.dtypes)
    out = d.withColumns({f: F.col(f"_{f}.value") if kinds[f] == "string" else F.col(f"_{f}.value").try_cast(kinds[f]) for f in fields})
    outcome = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"_{f}.outcome") for f in fields]))
    return out.withColumn("outcomes", F.map_filter(outcome, lambda _, v: v != "no evidence")).drop("ev", *merged)


def resolve_places(listings: DataFrame, geocoded: DataFrame, searched: DataFrame) -> DataFrame:
    """Address tiers over lookup tables. A row asks with its group's longest building text. A numbered address takes its geocoded candidate
    that is not rejected; a bare name first takes the searched address of at least two sources, then what the geocoder has for the name.
    geocoded: query, address, lat, lng, postcode; searched: name, address, sources. A postcode of the source stays as it is."""
    w = Window.partitionBy("doc_id", text.match_norm(F.col("building")))
    d = listings.withColumn("asked", F.max_by("building", F.struct(F.length("building"), -F.col("ordinal"))).over(w))
    d = d.withColumn("query", text.match_norm(address.geocode_query(address.spelled_to_digits(F.col("asked")), F.col("property_postcode")))).withColumn("bare", ~F.col("asked").rlike("[0-9]"))
    hits = searched.filter("sources >= 2").groupBy(text.match_norm(F.col("name")).alias("name_key")).agg(F.min_by("address", F.struct(-F.col("sources"), "address")).alias("found_address"))
    d = d.join(hits, text.match_norm(F.col("asked")) == F.col("name_key"), "left")
    d = d.withColumn("query", F.when(F.col("bare") & F.col("found_address").isNotNull(), text.match_norm(address.geocode_query(F.col("found_address"), F.lit("")))).otherwise(F.col("query")))
    c = geocoded.select(text.match_norm(F.col("query")).alias("query"), F.struct("address", "lat", "lng", "postcode").alias("g"))
    cand = d.select("doc_id", "ordinal", "query", F.coalesce("found_address", "asked").alias("want"), "property_postcode").join(c, "query")
    score = address.assess(address.parse_address(F.col("want")), address.parse_address(F.concat_ws(", ", "g.address", "g.postcode")))
    best = cand.withColumn("s", score).filter("not s.rejected").groupBy("doc_id", "ordinal").agg(F.max_by("g", F.struct("s.score", F.negative("g.lat"), F.negative("g.lng"))).alias("g"))
    d = d.join(best, ["doc_id", "ordinal"], "left")
    own = F.col("property_postcode") != ""
    found = F.coalesce(F.nullif(address.postcode(F.col("found_address")), F.lit("")), F.nullif(F.upper("g.postcode"), F.lit("")))
    return d.withColumns(
        {
            "lat": F.col("g.lat"), "lng": F.col("g.lng"), "geo_status": F.when(F.col("g").isNotNull(), "derived").otherwise("manual"),
            "postcode_status": F.when(own, F.col("postcode_status")).when(found.isNotNull(), "derived").otherwise("manual"), "property_postcode": F.when(own, F.col("property_postcode")).otherwise(F.coalesce(found, F.lit(""))),
            "property_address_1": address.street_only(F.col("asked")),
        }
    ).drop("asked", "query", "bare", "name_key", "found_address", "g")


def resolve_addresses(requests: DataFrame, candidates: DataFrame, key: str, enough: int = 80, close: int = 5) -> DataFrame:
    """key, status, address, postcode, confidence, sources, n_considered per request. A postcode in the request's own text settles it. Else its
    candidates are scored against it, each once by source and wording; those of at least `enough` points with a postcode count. One of another
    postcode within `close` points of the best is a conflict; else the best wins, and each further source of its postcode adds confidence.
    requests: key, address, postcode; candidates: key, address, source, ordinal."""
    own = F.coalesce(F.nullif(address.postcode(F.col("postcode")), F.lit("")), F.nullif(address.postcode(F.col("address")), F.lit("")))
    r = requests.select(key, F.coalesce("address", F.lit("")).alias("asked"), own.alias("own"))
    c = candidates.select(key, "address", "source", "ordinal", text.words_only(F.col("address")).alias("wording"))
    c = c.groupBy(key, "source", "wording").agg(F.min_by(F.struct("address", "ordinal"), "ordinal").alias("c")).select(key, "source", "c.*")
    d = r.filter("own is null").join(c, key).withColumn("p", address.parse_address(F.col("address")))
    d = d.withColumn("s", address.assess(address.parse_address(F.col("asked")), F.col("p"))).select(key, "address", "source", "ordinal", F.col("p.postcode").alias("code"), "s.score", (~F.col("s.rejected") & (F.col("s.score") >= enough) & (F.col("p.postcode") != "")).alias("valid"))
    rank = F.struct("score", -F.col("ordinal"), "source")
    best = d.groupBy(key).agg(F.max_by(F.struct("address", "source", "code", "score"), F.when(F.col("valid"), rank)).alias("b"), F.count(F.lit(1)).alias("n_considered"))
    told = d.filter("valid").join(best.filter("b is not null").select(key, "b"), key).groupBy(key).agg(
        F.bool_or((F.col("code") != F.col("b.code")) & (F.col("score") >= F.col("b.score") - close)).alias("conflict"),
        F.sort_array(F.collect_set(F.when(F.col("code") == F.col("b.code"), F.col("source")))).alias("sources"),
    )
    out = r.join(best, key, "left").join(told, key, "left")
    by_source = F.create_map(*[F.lit(v) for kv in address.RESOLVED_BY.items() for v in kv])
    status = (
        F.when(F.col("own").isNotNull(), "RESOLVED_FROM_SOURCE")
        .when(F.col("b").isNull(), "MANUAL_REVIEW_REQUIRED")
        .when(F.col("conflict"), "CONFLICTING_CANDIDATES")
        .otherwise(F.coalesce(F.try_element_at(by_source, F.col("b.source")), F.lit("RESOLVED_FROM_VALIDATED_LOOKUP")))
    )
    won = F.col("own").isNull() & F.col("b").isNotNull() & ~F.coalesce("conflict", F.lit(False))
    more = F.greatest(F.size("sources") - 1, F.lit(0))
    return out.select(
        key, status.alias("status"), F.when(F.col("own").isNotNull(), F.col("asked")).when(won, F.col("b.address")).otherwise("").alias("address"), F.coalesce("own", F.when(won, F.col("b.code")), F.lit("")).alias("postcode"),
        F.when(F.col("own").isNotNull(), 1.0).when(won, F.least(F.lit(1.0), F.col("b.score") / 100 + 0.08 * more)).otherwise(0.0).alias("confidence"),
        F.when(F.col("own").isNotNull(), F.array(F.lit("source_file"))).when(won, F.col("sources")).otherwise(F.array().cast("array<string>")).alias("sources"), F.coalesce("n_considered", F.lit(0)).alias("n_considered"),
    )


def share_media(listings: DataFrame, fields: tuple[str, ...] = ("brochure_url", "floor_plan_url", "high_res_url")) -> DataFrame:
    """Blank media fields take those of the building's best supplied listing of the document."""
    w = Window.partitionBy("doc_id", F.lower("building"))
    filled = sum((F.when(F.col(f) != "", 1).otherwise(0) for f in fields), F.lit(0))
    d = listings.withColumn("_d", F.max_by(F.struct(*fields), F.struct(filled.alias("n"), (-F.col("ordinal")).alias("o"))).over(w))
    named = F.col("building") != ""
    return d.withColumns({f: F.when(named & (F.col(f) == ""), F.col(f"_d.{f}")).otherwise(F.col(f)) for f in fields}).drop("_d")


def pick_assets(assets: DataFrame, key: list[str], photos: int = 8, plans: int = 4) -> DataFrame:
    """Assets (url, content_hash, class, confidence, ordinal) once per canonical address or content, the best first: at most so many photos and
    plans of each key, other classes all."""
    identity = F.coalesce(F.nullif(urls.canonical(F.col("url")), F.lit("")), F.concat(F.lit("embedded:"), F.col("content_hash")))
    once = F.row_number().over(Window.partitionBy(*key, identity).orderBy("ordinal"))
    d = assets.withColumn("_n", once).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy(*key, "class").orderBy(F.col("confidence").desc(), "ordinal"))
    most = F.when(F.col("class") == "photo", photos).when(F.col("class") == "floorplan", plans)
    return d.withColumn("_n", place).filter(most.isNull() | (F.col("_n") <= most)).drop("_n")


def shown_column(field: str) -> Column:
    """A field as it is displayed: flags as Yes and No, derived coordinates and postcodes marked."""
    status = {"lat": "geo_status", "lng": "geo_status", "property_postcode": "postcode_status"}.get(field)
    if field in ("for_sale", "to_let"):
        return F.when(F.col(field), "Yes").otherwise("No")
    if not status:
        return F.col(field)
    value = F.coalesce(F.col(field).cast("string"), F.lit(""))
    return F.when(F.col(status) == "manual", F.lit("Needs manual lookup")).when((value != "") & (F.col(status) == "derived"), F.concat(value, F.lit(" (Not in source text)"))).otherwise(value)


def export(listings: DataFrame) -> DataFrame:
    """The display columns in order."""
    return listings.select(*[shown_column(f).alias(name) for name, f in COLUMNS])


def final_photos(assets: DataFrame, verdicts: DataFrame, listings: DataFrame, most: int = 8) -> DataFrame:
    """Per listing its photos as an array and the reasons for those left out. A photo must be usable by its verdict (url, verdict, content_hash),
    must not be the listing's plan, and counts once by content. assets: doc_id, ordinal, place, url."""
    key = ["doc_id", "ordinal"]
    d = assets.join(verdicts, "url", "left").join(listings.select(*key, "floor_plan_url"), key)
    same_plan = urls.canonical(F.col("url")) == urls.canonical(F.col("floor_plan_url"))
    d = d.withColumn("reason", F.when(same_plan, "plan").when(F.col("verdict").isNull(), "not checked").when(F.col("verdict") != "ok", F.col("verdict")))
    once = F.row_number().over(Window.partitionBy(*key, F.coalesce("reason", F.lit("ok")), F.coalesce("content_hash", "url")).orderBy("place"))
    d = d.withColumn("reason", F.when(F.col("reason").isNull() & (once > 1), "repeated").otherwise(F.col("reason")))
    ordered = lambda cond, what: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("place", what.alias("x"))))), lambda s: s["x"])
    g = d.groupBy(*key).agg(ordered(F.col("reason").isNull(), F.col("url")).alias("photos"), ordered(F.col("reason").isNotNull(), F.concat_ws(": ", "url", "reason")).alias("left_out"))
    return g.withColumn("photos", F.slice("photos", 1, most)).withColumn("high_res", F.when(F.size("photos") == 1, F.get("photos", F.lit(0))).when(F.size("photos") > 1, F.lit("gallery")).otherwise(""))

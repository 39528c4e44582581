"""Evidence from linked resources: what a page says about a property, gated by identity, spread to all rows that link to it.

resources: url, content_type, payload (binary) — fetched beforehand; nothing here opens a connection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import merge, numbers, text, urls
from ..functions.address import POSTCODE
from . import groups

#: Fields that hold for a whole building; all others need the same floor.
BUILDING_FIELDS = ("property_postcode", "min_term", "state_of_space", "special_features", "contacts")
PAGE = "text string, links array<struct<text:string,url:string>>, images array<struct<url:string,alt:string,association:double>>"


def _parse(payload: pd.Series) -> pd.DataFrame:
    from ..sources.html import parse_html

    pages = [parse_html(bytes(p or b"").decode("utf-8", "replace")) for p in payload]
    return pd.DataFrame([{k: p[k] for k in ("text", "links", "images")} for p in pages], columns=["text", "links", "images"])


def typed(resources: DataFrame) -> DataFrame:
    """Adds key (the canonical address), resource_type and, for pages, the parsed page."""
    d = resources.withColumns({"key": urls.canonical(urls.direct_download(urls.unwrapped(F.col("url")))), "resource_type": urls.resource_type(F.col("payload"), F.col("content_type"))})
    return d.withColumn("page", F.when(F.col("resource_type") == "html", F.pandas_udf(_parse, PAGE)("payload")))


def nested_documents(resources: DataFrame, most: int = 2) -> DataFrame:
    """(key, document): the first document links of each page, resolved against it."""
    link = resources.select("key", "url", F.posexplode("page.links").alias("pos", "l")).withColumn("document", urls.canonical(urls.resolve(F.col("url"), F.col("l.url"))))
    link = link.filter(urls.is_document_like(F.col("document"))).groupBy("key", "document").agg(F.min("pos").alias("pos"))
    return groups.rank_candidates(link, ["key"], urls.document_rank(F.col("document")), ["pos"]).filter(F.col("rank") <= most).select("key", "document")


def plan_candidates(resources: DataFrame) -> DataFrame:
    """(key, ordinal, url, label, kind): floor plans that pages point to, in the order in which they are tried. resources: key, url, payload."""

    def find(url: pd.Series, payload: pd.Series) -> pd.Series:
        from ..sources.html import plan_links

        return pd.Series([plan_links(bytes(p or b"").decode("utf-8", "replace"), u or "") for u, p in zip(url, payload, strict=True)])

    found = F.pandas_udf(find, "array<struct<url: string, label: string, kind: string>>")
    return resources.select("key", F.posexplode(found("url", "payload")).alias("ordinal", "p")).select("key", "ordinal", "p.*")


def candidates(resources: DataFrame) -> DataFrame:
    """(key, url, class, confidence, ordinal): the classified images of pages."""
    d = resources.select("key", F.col("url").alias("base"), F.posexplode("page.images").alias("ordinal", "i"))
    c = urls.asset_class(urls.resolve(F.col("base"), F.col("i.url")), F.lit(""), F.col("i.alt"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1), F.col("i.association"))
    return d.select("key", urls.canonical(urls.resolve(F.col("base"), F.col("i.url"))).alias("url"), F.lit("").alias("content_hash"), c["class"].alias("class"), c["confidence"].alias("confidence"), "ordinal")


def fields(resources: DataFrame) -> DataFrame:
    """(key, page_text, floor, field, value, confidence): values that a page states without contradicting itself."""
    t = F.coalesce(F.col("page.text"), F.lit(""))
    all_of = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    codes = F.transform(F.regexp_extract_all(t, F.lit(rf"\b({POSTCODE})\b"), F.lit(1)), lambda c: F.upper(c))
    size = groups.unanimous(F.transform(all_of(r"(?i)\b([0-9][0-9,]*) *sq\.? *ft"), lambda s: F.replace(s, F.lit(","), F.lit(""))))
    price = groups.unanimous(F.transform(all_of(r"(?i)£ *([0-9][0-9,]*) *(?:pcm|per month)"), lambda s: F.replace(s, F.lit(","), F.lit(""))))
    found = {
        "property_postcode": (groups.unanimous(codes), 0.9),
        "size_sqft": (size, 0.85),
        "desks_max": (groups.unanimous(all_of(r"(?i)\b([0-9]+) *desks?\b")), 0.8),
        "price_pcm": (price, 0.85),
        "min_term": (F.nullif(text.min_term(F.regexp_extract(t, r"(?i)(?:min(?:imum)?\.? term|lease)[: ]+([^\n]{1,40})", 1)), F.lit("")), 0.8),
        "state_of_space": (F.nullif(text.status_tag(t), F.lit("")), 0.75),
        "contacts": (F.nullif(text.contact_text(F.regexp_extract(t, r"(?i)contact[: ]+([^\n]{1,120})", 1)), F.lit("")), 0.75),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value"), F.lit(c).alias("confidence")) for k, (v, c) in found.items()])
    d = resources.filter("resource_type = 'html'").select("key", t.alias("page_text"), text.floor_token(t).alias("floor"), F.explode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("f"))
    return d.select("key", "page_text", "floor", "f.*")


def for_listings(listings: DataFrame, resources: DataFrame) -> DataFrame:
    """(doc_id, ordinal, field, value, confidence): each page is read once and its evidence goes to every row with its address, if the page
    is about the property; values of a unit only if it is the same floor."""
    seeds = listings.select("doc_id", "ordinal", "building", "property_address_1", "property_postcode", "floor_unit", F.explode(F.array_distinct(F.filter(F.array(urls.canonical(F.col("brochure_url"))), lambda u: u != ""))).alias("key"))
    d = seeds.join(fields(resources), "key")
    same = merge.identity(F.col("building"), F.col("property_address_1"), F.col("property_postcode"), F.col("page_text"))
    floor = text.floor_token(F.col("floor_unit"))
    fits = F.col("field").isin(*BUILDING_FIELDS) | (F.col("floor") == "") | (F.col("floor") == floor)
    return d.filter(same.isin("MATCH", "PROBABLE_MATCH") & fits).select("doc_id", "ordinal", "field", "value", "confidence")


def size_conflicts(listings: DataFrame, found: DataFrame) -> DataFrame:
    """Evidence of sizes beyond the tolerance."""
    d = listings.select("doc_id", "ordinal", "size_sqft").join(found.filter("field = 'size_sqft'"), ["doc_id", "ordinal"])
    return d.filter(~numbers.tolerant_equal(F.col("size_sqft"), F.col("value").try_cast("double")))

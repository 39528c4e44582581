"""The whole life of a set of files as one lazy plan: documents, listings, issues and a report per file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import evidence, extraction, layouts, listings, sequence, validation
from ..sources import files


@dataclass
class Result:
    documents: DataFrame
    listings: DataFrame
    reports: DataFrame


def process(
    docs: DataFrame,
    resources: DataFrame | None = None,
    geocoded: DataFrame | None = None,
    searched: DataFrame | None = None,
    model: Callable[[str], str] | None = None,
    today: str | None = None,
) -> Result:
    """docs: the columns of files.DOCUMENT. resources, geocoded and searched are lookup tables (see evidence and listings); model stands in
    for a provider, and sees only documents that no layout fits. Evidence comes before addresses, checks come last."""
    good = docs.filter("status = 'ok'")
    rows = files.table_rows(good)
    raw = layouts.dispatch(good.select("doc_id", "text", "sender", "subject"), rows).drop("rule_rank")
    if model:
        rest = good.join(raw.select("doc_id").distinct(), "doc_id", "left_anti")
        lines = sequence.text_lines(rest.select("doc_id", "text")).select("doc_id", F.lit(0).alias("table_idx"), F.col("line_no").alias("row_idx"), F.array("line").alias("cells"))
        raw = raw.unionByName(extraction.extracted(extraction.ask(extraction.chunks(lines), model)).withColumn("parser", F.lit("model")))
    out = listings.normalize(raw)
    if resources is not None:
        typed = evidence.typed(resources)
        found = evidence.for_listings(out, typed)
        out = listings.apply_evidence(out, found, ["property_postcode", "size_sqft", "desks_max", "price_pcm", "min_term", "state_of_space", "contacts"])
    if geocoded is not None and searched is not None:
        out = listings.resolve_places(out, geocoded, searched)
    out = listings.share_media(out)
    date = dates.source_date(F.col("date"), F.col("file_date"), F.col("filename"), F.col("file_mtime_year"), F.to_date(F.lit(today)) if today else F.current_date())
    about = good.select("doc_id", F.col("filename").alias("source_file"), F.concat_ws("_", F.nullif(text.sanitize_name(text.provider_from_filename(F.col("filename"))), F.lit("")), date).alias("ref"))
    out = out.join(about, "doc_id").withColumns({"external_ref": F.col("ref"), "source_url": F.lit(""), "source_url_expected": F.lit(False)}).drop("ref")
    out = validation.with_issues(listings.with_provenance(out, "layout"), validation.listing_rules())
    return Result(docs, out, reports(docs, out))


def reports(docs: DataFrame, out: DataFrame) -> DataFrame:
    """A row per file: status, rows, issues, the area if all rows agree, a display name that is unique, and whether it needs a review."""
    from ..operators import groups

    g = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("record_count"), F.sum(F.size("issues")).alias("issue_count"), F.bool_or("review_required").alias("review_required"), groups.consensus(F.col("area")).alias("area"), F.first("parser").alias("method"))
    d = docs.select("doc_id", "filename", "status", "error").join(g, "doc_id", "left")
    d = d.withColumn("record_count", F.coalesce("record_count", F.lit(0))).withColumn("error", F.when((F.col("status") == "ok") & (F.col("record_count") == 0), F.lit("no listings found")).otherwise(F.col("error")))
    d = d.withColumn("status", F.when(F.col("error") != "", "error").otherwise(F.col("status")))
    name = F.concat_ws(" - ", F.nullif(text.sanitize_name(text.provider_from_filename(F.col("filename"))), F.lit("")), F.col("area"))
    d = d.withColumn("name", name)
    d = sequence.unique_names(d, "name", ["doc_id"], "unique_name")
    return d.withColumn("output_name", F.concat("unique_name", F.lit(".xlsx"))).drop("name", "unique_name")


def process_files(spark: SparkSession, path: str, **options) -> Result:
    return process(files.read_documents(spark, path), **options)

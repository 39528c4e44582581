"""Outputs: a workbook per source file, a QA sheet, a photo gallery, plain tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.listings import COLUMNS, shown_column
from .office import write_xlsx

QA_COLUMNS = ["Source File", "Property/Building", "Field", "Issue", "Severity", "Extracted Value", "Suggested Review Action"]
LINKS = frozenset({"Brochure PDF", "Floor Plan", "High Res Images"})


def qa_rows(listings: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Issues of listings and diagnostics that need a look, one sheet row each; a source without any has one row that says so."""
    # an outer explode, as for a plain one the optimizer copies the rules into filters that evaluate them again
    issue = listings.select("doc_id", F.col("building"), F.posexplode_outer("issues").alias("at", "i")).filter("at is not null").select("doc_id", "building", "i.field", "i.message", "i.severity", "i.value", "i.action")
    noted = diagnostics.filter(F.col("status") != "ok").select("doc_id", "building", F.col("resource_type").alias("field"), F.col("detail").alias("message"), F.when(F.col("status").contains("conflict"), "error").otherwise("warning").alias("severity"), F.col("original_url").alias("value"), F.lit("check the link").alias("action"))
    clear = listings.groupBy("doc_id").agg(F.max(F.size("issues")).alias("most")).filter("doc_id is null or not coalesce(most > 0, false)")
    none = clear.join(noted.select("doc_id").distinct(), "doc_id", "left_anti")
    blank = none.select("doc_id", *[F.lit(v).alias(c) for c, v in (("building", ""), ("field", ""), ("message", "No issues found"), ("severity", "info"), ("value", ""), ("action", ""))])
    return issue.unionByName(noted).unionByName(blank)


def workbooks(listings: DataFrame, qa: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): a workbook per source file. A file's rows meet in one task, as they do in the file."""
    names = [n for n, _ in COLUMNS]
    rows = listings.select("doc_id", "ordinal", F.struct(*[shown_column(f).alias(n) for n, f in COLUMNS]).alias("r"))
    packed = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "r"))), lambda x: x["r"]).alias("rows"))
    if qa is not None:
        cells = F.array(*[F.col(c).cast("string") for c in ("doc_id", "building", "field", "message", "severity", "value", "action")])
        q = qa.groupBy("doc_id").agg(F.sort_array(F.collect_list(cells)).alias("qa"))
        packed = packed.join(q, "doc_id", "left")
    else:
        packed = packed.withColumn("qa", F.lit(None).cast("array<array<string>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, listed, checks in zip(b["doc_id"], b["rows"], b["qa"], strict=True):
                sheets = [("Listings", names, [[r[n] for n in names] for r in listed])]
                if checks is not None:
                    sheets.append(("QA Review", QA_COLUMNS, [list(c) for c in checks]))
                out.append((doc, write_xlsx(sheets, LINKS)))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    return packed.select("doc_id", "rows", "qa").mapInPandas(run, f"doc_id {listings.schema['doc_id'].dataType.simpleString()}, content binary")


def gallery_html(title: Column, urls: Column) -> Column:
    """A page of photos, for two or more; else null."""
    safe = lambda s: F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    images = F.array_join(F.transform(urls, lambda u: F.concat(F.lit('<img loading="lazy" src="'), safe(u), F.lit('">'))), "\n")
    return F.when(F.size(urls) >= 2, F.concat(F.lit("<!DOCTYPE html><html><head><title>"), safe(title), F.lit("</title></head><body>\n"), images, F.lit("\n</body></html>")))


def distinct_artifact(source: Column, output: Column) -> Column:
    """A source file's name that does not collide with the output's."""
    return F.when(F.lower(source) == F.lower(output), F.regexp_replace(source, r"(\.[^.]*)?$", " (original)$1")).otherwise(source)

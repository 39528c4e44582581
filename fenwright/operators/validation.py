"""Row checks. They never change a value; each failed rule is an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.address import postcode


def rule(field: str, message: str, severity: str, failed: Column, value: Column, action: str = "check the source") -> Column:
    issue = F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(severity).alias("severity"), value.alias("value"), F.lit(action).alias("action"))
    return F.when(failed, issue)


def with_issues(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Adds issues, an array, and review_required: a warning or an error is among them."""
    df = df.withColumn("issues", F.filter(F.array(*rules), lambda i: i.isNotNull()))
    return df.withColumn("review_required", F.exists("issues", lambda i: i["severity"].isin("warning", "error")))


def issues(df: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    return with_issues(df, rules).select(key, F.explode("issues").alias("i")).select(key, "i.*")


def listing_rules() -> list[Column]:
    """The checks of a listing."""
    c, none = F.col, lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    named, canon = ({u: f(c(u)) for u in ("brochure_url", "floor_plan_url", "high_res_url")} for f in (urls.is_address, urls.canonical))
    same = lambda a, b: named[a] & named[b] & (canon[a] == canon[b])
    out = [
        rule("source_file", "source file name lost", "error", none("source_file"), c("source_file")),
        rule("source_url", "source address invalid", "error", ~none("source_url") & ~urls.is_address(c("source_url")), c("source_url")),
        rule("source_url", "source address missing", "warning", none("source_url") & F.coalesce(c("source_url_expected"), F.lit(False)), c("source_url")),
        rule("building", "building missing", "error", none("building"), c("building")),
        rule("property_address_1", "address missing", "error", none("property_address_1"), c("property_address_1")),
        rule("size_sqft", "size missing", "warning", c("size_sqft").isNull(), c("size_sqft").cast("string")),
        rule("property_postcode", "postcode not valid", "error", ~none("property_postcode") & (c("postcode_status") != "manual") & (postcode(c("property_postcode")) == ""), c("property_postcode")),
        rule("property_postcode", "postcode needs manual lookup", "warning", none("property_postcode") | (c("postcode_status") == "manual"), c("property_postcode")),
        rule("property_postcode", "postcode not in source text", "warning", c("postcode_status") == "derived", c("property_postcode")),
        rule("property_address_1", "address sources conflict", "warning", c("geo_status").isin("conflict", "none", "manual"), c("geo_status")),
    ]
    for field, forbid in (("brochure_url", True), ("floor_plan_url", False), ("high_res_url", False)):
        problem = urls.url_problem(F.coalesce(c(field), F.lit("")), forbid)
        out.append(rule(field, "address unusable", "error", problem.isNotNull(), c(field)))
    for a, b in (("floor_plan_url", "brochure_url"), ("high_res_url", "brochure_url"), ("high_res_url", "floor_plan_url")):
        out.append(rule(a, f"same as {b}", "error", same(a, b), c(a)))
    return out

"""Operator 2: URL filters, with DataFrame functions only.

Each distinct URL is expanded into expressions, one for each suffix of its host at a label and each prefix of its path that
is empty or ends in a slash. A rule is filed under its host and its path up to the last slash. Expressions and rules meet
in an equi-join on the first 32 bits of a SHA-256 digest; the full digest, and what follows the rule's last slash, are then
confirmed, and the longest rule wins (with equal length the one with the longer host, then the smaller text).

No expression deeper than the deepest rule is made, as none could match. The rules are broadcast if there are at most
`broadcast_rules` of them; beyond that the join shuffles both sides and adaptive execution splits hot keys. URLs are judged
once each, and the rows of a frequent one are dealt out when they get their verdict.

Defined cases: a null URL or one without `://` has an empty host and path and no rule; a rule with an empty or null host
never fits; rules that are equal in host and path with different verdicts: block wins; repeated rows are returned each; an
empty table gives no rows; other columns are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_back, lower_ascii, set_aside, stored, table

#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, folder), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """urls with the columns host, path, rule and verdict added (they replace columns of these names).

    rules: columns host, path, verdict ("allow" or "block"). default: the verdict where no rule fits."""
    names, kept = ["host", "path", "rule", "verdict"], urls.columns
    urls, back = set_aside(urls, ["u_url", "u_n", "u_row", "best", *(n for n in names if n != url)])
    # Rules, one per host and path; block sorts after allow.
    r = rules.select(lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    r = r.filter("r_host <> ''").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    folder = F.regexp_extract("r_path", r"(?s)^(.*/)?", 1)
    r = r.withColumn("r_digest", _digest(F.col("r_host"), folder)).withColumn("r_short", _short(F.col("r_digest")))
    bounds = r.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.size(F.split("r_path", "/"))).alias("slashes")).first()
    r = F.broadcast(r) if bounds["n"] <= broadcast_rules else r

    one = urls.groupBy(F.col(url).alias("u_url")).agg(F.count(F.lit(1)).alias("u_n")).withColumn("u_host", host_of(F.col("u_url"))).withColumn("u_path", path_of(F.col("u_url")))
    labels, steps = F.split("u_host", r"\."), F.split("u_path", "/")
    n_labels, n_steps = F.size(labels), F.size(steps)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n_labels, F.lit(bounds["labels"] or 1))), lambda k: F.array_join(F.slice(labels, n_labels - k + 1, k), "."))
    folders = F.transform(
        F.sequence(F.lit(0), F.least(n_steps - 1, F.lit((bounds["slashes"] or 1) - 1))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), F.greatest(k, F.lit(1))), "/"), F.lit("/"))),
    )
    expressions = one.filter("u_host <> ''").withColumn("e_host", F.explode(hosts)).withColumn("e_folder", F.explode(folders))
    expressions = expressions.withColumn("e_digest", _digest(F.col("e_host"), F.col("e_folder"))).withColumn("e_short", _short(F.col("e_digest")))
    hits = expressions.join(r, (F.col("e_short") == F.col("r_short")) & (F.col("e_digest") == F.col("r_digest")) & F.col("u_path").startswith(F.col("r_path")))
    rank = F.struct(-(F.length("r_host") + F.length("r_path")), -F.length("r_host"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("u_url", "u_n").agg(F.min_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), rank).alias("best"))
    total = urls.count()
    frequent = one.filter(F.col("u_n") * 1000 >= total).select("u_url", "u_n").join(best.select("u_url"), "u_url", "left_anti")  # a thousand at most
    best = stored(best.unionByName(frequent, allowMissingColumns=True), "verdicts")
    out = urls.withColumn("u_url", F.col(url).cast("string")).withColumn("u_row", F.monotonically_increasing_id())
    out = join_back(out, best, ["u_url"], "u_n", total, ["u_row"])
    out = out.withColumn("host", host_of(F.col("u_url"))).withColumn("path", path_of(F.col("u_url")))
    return out.withColumn("rule", F.col("best.rule")).withColumn("verdict", F.coalesce("best.r_verdict", F.lit(default))).drop("u_url", "u_n", "u_row", "best").withColumnsRenamed({k: c for k, c in back.items() if c.lower() not in names}).select(*[c for c in kept if c.lower() not in names or c == url], *names)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS k
  FROM pages),
r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT k, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY k ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_host || r_path) AS place
  FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.r_verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.k = p.k AND m.place = 1
"""

"""Operator 6: quality rules by distribution divergence, with DataFrame functions only.

Base rules come first (too few words; too many words in repeated three-word windows). A document that passes them is
compared with its language: the shares of character classes, and of common words, against the mean shares of all documents
of that language that pass the base rules, by the Jensen-Shannon divergence in bits. A histogram counts only if the
text is long enough for it (`min_chars`, `min_words`). A document is rejected if a divergence is above its threshold.

All figures of a document come from its own row, in one scan; only sums per language are shuffled. Shares are whole
millionths, so that sums do not depend on their order.

Defined cases: a null text is an empty one (0 in all figures, rejected by the base rules); a null or unknown language is a
language like any other for the character classes, and its common words are those of all languages; repeated rows count as
often as they occur; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, words

#: Common words of each language (fixed values).
COMMON = {
    "en": "the of and to in is that for was with this on are by from as it be an at or a",
    "fr": "le la les de des du et en un une que qui dans pour sur par est avec au pas ce il",
    "de": "der die das und in zu den von mit ist des dem nicht ein eine sich auf im auch es als an",
    "es": "el la los las de del y que en un una por con para se es su no al lo como más",
}
_ALL = sorted({w for v in COMMON.values() for w in v.split()})


def _windows(w: Column, n: Column) -> Column:
    """Hashes of all three-word windows."""
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3)
    return F.when(n >= 3, F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def figures(docs: DataFrame) -> DataFrame:
    """Per document: the base figures, char_hist and word_hist (shares in millionths)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("t"), words(text).alias("w"))
    n = F.size("w")
    d = d.select("doc_id", "lang", "t", "w", n.alias("n"), _windows(F.col("w"), n).alias("g")).withColumn("repeats", F.size("g") > F.size(F.array_distinct("g")))
    # Only a text with a repeated window sorts its windows; equal ones are then neighbours.
    placed = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.col("repeats"), placed))
    s = F.col("s")
    twice = F.filter(s, lambda x, i: (x["x"] == F.get(s, i - 1)["x"]) | (x["x"] == F.get(s, i + 1)["x"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    d = d.withColumns(
        {
            "n_words": F.col("n").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.when(F.col("repeats"), covered).otherwise(0).cast("long"),
            "chars": F.length("t"),
            "letters": F.length("t") - without(r"\p{L}+"),
            "upper": without(r"\P{Lu}+"),
            "digits": without(r"\P{Nd}+"),
            "marks": without(r"[^.,;:!?'\"()-]+"),
        }
    )
    common = F.filter("w", lambda x: F.lower(x).isin(_ALL))
    d = d.withColumn("c", F.transform(common, lambda x: F.lower(x)))
    counts = F.transform(_words_of(), lambda x: F.size("c") - F.size(F.array_remove("c", x)))
    d = d.withColumn("counts", counts)
    share = lambda x, total: F.floor(x.cast("long") * 1_000_000 / F.greatest(total, F.lit(1)))
    sums = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    char_parts = [F.col("letters") - F.col("upper"), F.col("upper"), F.col("digits"), F.col("marks"), F.col("chars") - F.col("word_chars")]
    rest = F.col("word_chars") - F.col("letters") - F.col("digits") - F.col("marks")
    return d.select(
        *("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars"),
        F.array(*[share(x, F.col("chars")) for x in [*char_parts, rest]]).alias("char_hist"),
        F.concat(F.transform("counts", lambda x: share(x, F.col("n"))), F.array(share(F.col("n") - sums, F.col("n")))).alias("word_hist"),
    )


def _words_of() -> Column:
    """The common words to count in a document of a language."""
    out = F.array(*[F.lit(w) for w in _ALL])
    for lang, listed in COMMON.items():
        out = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in listed.split()])).otherwise(out)
    return out


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two histograms of equal length."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    once = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))  # noqa: E731  a value that is computed once, not for each element
    shares = lambda a: once(F.greatest(total(a), F.lit(1.0)), lambda s: F.transform(a, lambda x: x / s))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return total(F.zip_with(shares(p), shares(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2))


def judge(docs: DataFrame, min_words: int = 100, min_chars: int = 500, max_char: float = 0.07, max_word: float = 0.08, broadcast_rows: int = 10_000) -> DataFrame:
    """Base figures, base_failed, the divergences (null where a text is too short for one) and kept. The references, one row per
    language, are broadcast if there are at most broadcast_rows."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    f = stored(figures(docs).withColumn("base_failed", failed).withColumn("known", F.coalesce("lang", F.lit(""))), "figures")
    good = f.filter("not base_failed")
    means = []
    for hist in ("char_hist", "word_hist"):
        m = good.select("known", F.posexplode(hist).alias("k", "x")).groupBy("known", "k").agg(F.sum("x").alias("x"))
        means.append(m.groupBy("known").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias(f"mean_{hist}")))
    reference = stored(means[0].join(means[1], "known"), "references")
    reference = F.broadcast(reference) if reference.count() <= broadcast_rows else reference
    out = f.join(reference, "known", "left")
    out = out.withColumn("char_divergence", F.when(F.col("chars") >= min_chars, divergence(F.col("char_hist"), F.col("mean_char_hist"))))
    out = out.withColumn("word_divergence", F.when(F.col("n_words") >= min_words, divergence(F.col("word_hist"), F.col("mean_word_hist"))))
    bad = F.coalesce(F.col("char_divergence") > max_char, F.lit(False)) | F.coalesce(F.col("word_divergence") > max_word, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).select(
        *("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_divergence", "word_divergence", "lang")
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("char_divergence", "word_divergence", "lang")


def _sql_lists() -> str:
    cases = " ".join(f"WHEN '{lang}' THEN {listed.split()}" for lang, listed in COMMON.items())
    return f"CASE lang {cases} ELSE {_ALL} END"


def _sql_divergence(p: str, q: str) -> str:
    terms = f"list_sum(list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] / greatest(list_sum({p}), 1) * log2(z[1] / greatest(list_sum({p}), 1) / ((z[1] / greatest(list_sum({p}), 1) + z[2] / greatest(list_sum({q}), 1)) / 2)) ELSE 0 END"
    return f"{terms} + CASE WHEN z[2] > 0 THEN z[2] / greatest(list_sum({q}), 1) * log2(z[2] / greatest(list_sum({q}), 1) / ((z[1] / greatest(list_sum({p}), 1) + z[2] / greatest(list_sum({q}), 1)) / 2)) ELSE 0 END) / 2))"


OP6_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(lang, '') AS known, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_sql_lists()} AS common FROM documents),
g AS (SELECT r, i, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
gg AS (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM g),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM gg WHERE n > 1) GROUP BY r),
f AS (
  SELECT t.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(rep.n, 0) AS n_repeat_words, length(t) AS chars,
    length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS upper, length(regexp_replace(t, '\P{{Nd}}+', '', 'g')) AS digits,
    length(regexp_replace(t, '[^.,;:!?''"()-]+', '', 'g')) AS marks, list_transform(common, lambda c: len(list_filter(w, lambda x: lower(x) = c))) AS counts
  FROM t LEFT JOIN rep USING (r)),
s AS (
  SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_transform([letters - upper, upper, digits, marks, chars - word_chars, word_chars - letters - digits - marks], lambda x: floor(x * 1000000 / greatest(chars, 1))::BIGINT) AS ch,
    list_concat(list_transform(counts, lambda x: floor(x * 1000000 / greatest(n_words, 1))::BIGINT), [floor((n_words - coalesce(list_sum(counts), 0)) * 1000000 / greatest(n_words, 1))::BIGINT]) AS wh
  FROM f),
cm AS (SELECT known, list(x ORDER BY k) AS cm FROM (SELECT known, k, sum(x)::DOUBLE AS x FROM (SELECT known, unnest(ch) AS x, unnest(range(len(ch))) AS k FROM s WHERE NOT base_failed) GROUP BY known, k) GROUP BY known),
wm AS (SELECT known, list(x ORDER BY k) AS wm FROM (SELECT known, k, sum(x)::DOUBLE AS x FROM (SELECT known, unnest(wh) AS x, unnest(range(len(wh))) AS k FROM s WHERE NOT base_failed) GROUP BY known, k) GROUP BY known),
d AS (
  SELECT s.*, CASE WHEN chars >= 500 AND cm IS NOT NULL THEN {_sql_divergence("list_transform(ch, lambda v: v::DOUBLE)", "cm")} END AS cd, CASE WHEN n_words >= 100 AND wm IS NOT NULL THEN {_sql_divergence("list_transform(wh, lambda v: v::DOUBLE)", "wm")} END AS wd
  FROM s LEFT JOIN cm USING (known) LEFT JOIN wm USING (known))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(cd > 0.07, false) OR coalesce(wd > 0.08, false)) AS kept FROM d
"""

"""Queries over documents: lines, sections, chunks, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import groups, sequence
from .page_queries import read

KEY, ORDER = ["doc_id"], ["line_no"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.text_lines(read(spark, sf_dir, "documents"))
    return d.withColumn("line_no", F.col("line_no").cast("long")).withColumn("is_heading", F.length("line").between(1, 29))


_SQL_LINES = """lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents)),
h AS (SELECT *, length(line) BETWEEN 1 AND 29 AS is_heading FROM lines)"""


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.carry_forward(lines(spark, sf_dir), F.when(F.col("is_heading"), F.col("line")), "heading", KEY, ORDER)
    return d.select("doc_id", "line_no", F.coalesce("heading", F.lit("")).alias("heading"))


def bounded_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.look_back(lines(spark, sf_dir), F.when(F.col("is_heading"), F.col("line_no")), "heading_at", KEY, ORDER, 5)
    return d.filter(~F.col("is_heading") & F.col("heading_at").isNotNull()).select("doc_id", "line_no", "heading_at")


def bounded_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.look_ahead(lines(spark, sf_dir), F.col("line"), "next_line", KEY, ORDER, 1)
    d = sequence.look_ahead(d, F.when(F.length("line") > 400, F.col("line_no")), "long_at", KEY, ORDER, 25)
    return d.filter("is_heading").select("doc_id", "line_no", F.coalesce("next_line", F.lit("")).alias("next_line"), "long_at")


def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heading's section: its bounds and the characters of its lines under 500 characters."""
    d = sequence.islands(lines(spark, sf_dir), F.col("is_heading"), "section", KEY, ORDER).filter("section > 0")
    short = F.when(~F.col("is_heading") & (F.length("line") < 500), F.length("line")).otherwise(0)
    return d.groupBy("doc_id", "section").agg(F.min("line_no").alias("begin_line"), (F.max("line_no") + 1).alias("end_line"), F.min_by("line", "line_no").alias("heading"), F.sum(short).alias("body_chars"))


def row_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.chunk_rows(lines(spark, sf_dir), KEY, ORDER)
    return d.groupBy("doc_id", "chunk").agg(F.min("row_no").cast("long").alias("first_row"), F.max("row_no").cast("long").alias("last_row"), F.sum(F.length("line")).alias("chars")).withColumn("chunk", F.col("chunk").cast("long"))


_SQL_CHUNKS = """n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM lines),
chunks AS (SELECT doc_id, line_no, line, unnest(range(greatest(0, ceil((line_no - 24) / 23.0))::BIGINT, least(line_no // 23, CASE WHEN c <= 25 THEN 0 ELSE ceil((c - 2) / 23.0) - 1 END)::BIGINT + 1)) AS chunk FROM n)"""


def chunk_overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put together again: each line once."""
    d = sequence.chunk_rows(lines(spark, sf_dir), KEY, ORDER)
    once = sequence.first_seen(d, [F.col("doc_id"), F.col("line_no")], ["chunk"])
    return once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.max("chunk").cast("long").alias("last_chunk"))


def word_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace("text", "\\s+", " ")
    n = F.size(F.split(F.trim(t), " "))
    head = F.array_join(F.slice(F.split(F.trim(t), " "), 1, 100), " ")
    return read(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("words"), F.when(n <= 100, F.trim(t)).otherwise(F.concat(head, F.lit("..."))).alias("capped"))


def prose_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 words, up to the last full sentence or item."""
    return read(spark, sf_dir, "documents").select("doc_id", text.cap_prose(F.regexp_replace("text", "\\s+", " ")).alias("capped"))


def boilerplate_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are left when those of more than two documents go."""
    d = lines(spark, sf_dir).withColumn("hash", F.md5("line"))
    kept = d.join(groups.boilerplate(d, "hash", "doc_id"), "hash", "left_anti")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def single_char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda s: s != "")
    d = read(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    kept = text.without_single_chars(F.col("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(kept).cast("long").alias("kept"), F.md5(F.array_join(kept, " ")).alias("kept_md5"), F.size(F.filter("w", text.is_junk_token)).cast("long").alias("junk"), text.is_noise(F.concat_ws(";", F.slice("w", 1, 40))).alias("noise"))


def unanimous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)).alias("m"))
    return d.filter(F.size("m") > 0).select("doc_id", F.size("m").cast("long").alias("found"), groups.unanimous(F.col("m")).alias("value"))


def number_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), numbers.first_number(F.col("text")).alias("first"), F.lit(None).cast("double").alias("strict"))
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), numbers.first_number(F.col("p_brand")).alias("first"), numbers.to_number(F.col("p_brand")).alias("strict"))
    sample = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(SAMPLES)], "key string, x string")
    return docs.unionByName(parts).unionByName(sample.select("key", numbers.first_number(F.col("x")).alias("first"), numbers.to_number(F.col("x")).alias("strict")))


#: Inputs of number_coercion (fixed values).
SAMPLES = ["1,200", "£12.5", " 7 ", "n/a", "", "1.5d", "nan", "12-15", "-3", "1_000"]


def contact_names_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    composed = F.concat(F.col("c_name"), F.lit(", "), F.lower(F.col("c_mktsegment")), F.lit("@mail.example, 020 7946 "), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return c.select("c_custkey", text.names_only(composed).alias("names"), F.size(F.regexp_extract_all(composed, F.lit("([a-z]+@[a-z.]+)"), F.lit(1))).cast("long").alias("mails"))


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.wrapped_lines(F.col("text"), 45).alias("lines"), (text.wrapped_lines(F.col("text"), 45) * 15).alias("height"))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source by how many lines they have, as listings by their photos."""
    n = lines(spark, sf_dir).groupBy("doc_id").agg((F.count(F.lit(1)) - 1).alias("images"))
    d = read(spark, sf_dir, "documents").join(n, "doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), *groups.coverage(F.col("images")), F.count("quality").alias("labelled"), F.count_distinct("lang").alias("languages"))


def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import matching

    cache = read(spark, sf_dir, "labels").select("doc_id", F.lit(2).alias("logic_version"), (F.col("quality") == 0).alias("low_confidence"))
    wanted = read(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("confident"))
    hits, misses = matching.cache_lookup(wanted, cache, "doc_id", 2)
    return hits.select("doc_id", F.lit("hit").alias("result")).unionByName(misses.select("doc_id", F.lit("miss").alias("result")))


QUERIES = {f.__name__: f for f in (carry_forward, bounded_lookback, bounded_lookahead, section_blocks, row_chunks_overlap, chunk_overlap_dedupe, word_cap, prose_cap, boilerplate_hash, single_char_runs, unanimous_value, number_coercion, contact_names_only, wrapped_lines, coverage_report, cache_hit_miss)}

_FIRST = "TRY_CAST(replace(regexp_extract({0}, '([0-9][0-9,]*(\\.[0-9]+)?)', 1), ',', '') AS DOUBLE)"
_STRICT = "CASE WHEN regexp_full_match(regexp_replace(trim({0}), '[£,]', '', 'g'), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(regexp_replace(trim({0}), '[£,]', '', 'g') AS DOUBLE) END"
_NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
SQL = {
    "carry_forward": f"WITH {_SQL_LINES} SELECT doc_id, line_no, coalesce(last_value(CASE WHEN is_heading THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS heading FROM h",
    "bounded_lookback": f"WITH {_SQL_LINES}, b AS (SELECT *, max(CASE WHEN is_heading THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS heading_at FROM h) SELECT doc_id, line_no, heading_at FROM b WHERE NOT is_heading AND heading_at IS NOT NULL",
    "bounded_lookahead": f"WITH {_SQL_LINES}, b AS (SELECT *, lead(line) OVER w AS nl, min(CASE WHEN length(line) > 400 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING) AS long_at FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) SELECT doc_id, line_no, coalesce(nl, '') AS next_line, long_at FROM b WHERE is_heading",
    "section_blocks": f"WITH {_SQL_LINES}, s AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM h) SELECT doc_id, section, min(line_no) AS begin_line, max(line_no) + 1 AS end_line, arg_min(line, line_no) AS heading, sum(CASE WHEN NOT is_heading AND length(line) < 500 THEN length(line) ELSE 0 END)::BIGINT AS body_chars FROM s WHERE section > 0 GROUP BY doc_id, section",
    "row_chunks_overlap": f"WITH {_SQL_LINES}, {_SQL_CHUNKS} SELECT doc_id, chunk, min(line_no) AS first_row, max(line_no) AS last_row, sum(length(line))::BIGINT AS chars FROM chunks GROUP BY doc_id, chunk",
    "chunk_overlap_dedupe": f"WITH {_SQL_LINES}, {_SQL_CHUNKS}, o AS (SELECT doc_id, line_no, min(chunk) AS chunk, any_value(line) AS line FROM chunks GROUP BY doc_id, line_no) SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars, max(chunk) AS last_chunk FROM o GROUP BY doc_id",
    "word_cap": f"SELECT doc_id, len(str_split({_NORM}, ' ')) AS words, CASE WHEN len(str_split({_NORM}, ' ')) <= 100 THEN {_NORM} ELSE array_to_string(str_split({_NORM}, ' ')[1:100], ' ') || '...' END AS capped FROM documents",
    "prose_cap": f"""WITH t AS (SELECT doc_id, {_NORM} AS t, str_split({_NORM}, ' ') AS w FROM documents),
h AS (SELECT *, array_to_string(w[1:100], ' ') AS head FROM t),
p AS (SELECT *, regexp_extract(head, '^(.*[.!?])(?: .*)?$', 1) AS s, trim(regexp_extract(head, '^(.*);[^;]*$', 1)) AS i FROM h)
SELECT doc_id, CASE WHEN len(w) <= 100 THEN t WHEN s = '' AND i = '' THEN regexp_replace(head, '[.,;:!? ]+$', '') || '...'
  WHEN (len(str_split(s, ' ')), length(s)) >= (len(str_split(i, ' ')), length(i)) THEN s ELSE i END AS capped FROM p""",
    "boilerplate_hash": f"WITH {_SQL_LINES}, b AS (SELECT line FROM h GROUP BY line HAVING count(DISTINCT doc_id) > 2) SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM h ANTI JOIN b USING (line) GROUP BY doc_id",
    "single_char_runs": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda s: s <> '') AS w FROM documents),
c(c) AS (VALUES (str_split('space union from south north east west floor office kitchen fitted furnished available building street square house suite desk desks meeting rooms storage shower showers terrace reception lighting air conditioning raised floors bike cycle fibre fiber connectivity modern refurbishment natural light efficient floorplate agile work stations fully and the with for this that area unit ground first second third fourth fifth sixth seventh eighth ninth tenth london city spec type current footage size term rate price brochure contact features amenities description specification', ' '))),
k AS (SELECT DISTINCT unnest(w) AS s FROM t),
v AS (SELECT s, length(s) AS n, length(regexp_replace(s, '[^aeiou]', '', 'g')) AS v, list_contains(c, s) AS common, list_contains(c, reverse(s)) AND NOT list_contains(c, s) AND length(s) >= 4 AS back FROM k, c),
f AS (SELECT *, n >= 4 AND NOT common AND s NOT IN ('hvac', 'wifi') AND (back OR v = 0 OR (n >= 5 AND v * 10 <= n * 2) OR (regexp_matches(s, '[bcdfghjklmnpqrstvwxyz]{4,}') AND v * 100 < n * 35)) AS odd FROM v),
j AS (SELECT s, n, back, odd, s NOT IN ('ac', 'av', 'cat', 'epc', 'hr', 'hvac', 'it', 'led', 'm&e', 'mr', 'wc', 'wifi') AND (odd OR back OR n <= 2) AS junk,
  s IN ('floorsize', 'currentspec', 'squarefootage', 'minimumterm', 'monthlyrate', 'marketingprice', 'floorunit', 'desksmax', 'currentfloortype', 'sizesqft', 'pricepsqft', 'pricepsqf') AS head FROM f),
u AS (SELECT doc_id, unnest(w) AS s, unnest(range(len(w))) AS i FROM t),
a AS (SELECT doc_id, count(*) FILTER (junk) AS junk, count(*) FILTER (i < 40) AS parts, count(*) FILTER (i < 40 AND n = 1) AS single, count(*) FILTER (i < 40 AND back) AS back, count(*) FILTER (i < 40 AND odd) AS odd, count(*) FILTER (i < 40 AND head) AS heads FROM u JOIN j USING (s) GROUP BY doc_id)
SELECT doc_id, len(w) AS tokens, len(list_filter(w, lambda s: length(s) > 1)) AS kept, md5(array_to_string(list_filter(w, lambda s: length(s) > 1), ' ')) AS kept_md5, coalesce(junk, 0) AS junk,
  coalesce(parts > 0 AND (single >= 4 OR back >= 2 OR (back >= 1 AND single >= 2) OR (back + odd + heads + CASE WHEN single >= 2 THEN 1 ELSE 0 END >= 3 AND parts >= 5) OR (parts >= 6 AND (back + odd + heads + single) * 100 >= parts * 45)), false) AS noise
FROM t LEFT JOIN a USING (doc_id)""",
    "unanimous_value": "WITH t AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m FROM documents) SELECT doc_id, len(m) AS found, CASE WHEN len(list_distinct(m)) = 1 THEN m[1] END AS value FROM t WHERE len(m) > 0",
    "number_coercion": f"SELECT 'd' || doc_id AS key, {_FIRST.format('text')} AS first, NULL::DOUBLE AS strict FROM documents UNION ALL SELECT 'p' || p_partkey, {_FIRST.format('p_brand')}, {_STRICT.format('p_brand')} FROM part UNION ALL SELECT 's' || k, {_FIRST.format('x')}, {_STRICT.format('x')} FROM (VALUES "
    + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SAMPLES))
    + ") t(k, x)",
    "contact_names_only": "SELECT c_custkey, c_name AS names, len(regexp_extract_all(c_name || ', ' || lower(c_mktsegment) || '@mail.example', '([a-z]+@[a-z.]+)', 1)) AS mails FROM customer",
    "wrapped_lines": "WITH l AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS s FROM documents), n AS (SELECT doc_id, sum(greatest(1, ceil(length(s) / 45.0)))::BIGINT AS lines FROM l GROUP BY doc_id) SELECT doc_id, lines, lines * 15 AS height FROM n",
    "coverage_report": """WITH n AS (SELECT doc_id, source, lang, len(str_split(text, chr(10))) - 1 AS n FROM documents)
SELECT source, count(*) AS documents, count(*) FILTER (n > 0) AS with_images, count(*) FILTER (n = 0) AS blank, count(*) FILTER (n < 5) AS below_target, count(quality) AS labelled, count(DISTINCT lang) AS languages
FROM n LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "cache_hit_miss": "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND (lang = 'en' OR quality <> 0) THEN 'hit' ELSE 'miss' END AS result FROM documents d LEFT JOIN labels l USING (doc_id)",
}

"""Operator 3: line deduplication by a suffix array over line sequences, with DataFrame functions only.

A text is a sequence of its lines that hold more than white space; a line's id is a 128-bit hash of it. A run of lines that
occurs more than once is a repeat. Prefix doubling names the runs of 1, 2, 4, ... lines: a run's name is the pair of the ranks
of its halves, and the names that occur at least twice are sorted and ranked in turn, so a rank orders the suffixes by so
many lines. A place stays only while its run occurs at least twice: each round works on what the last one left. Places with one
rank are an interval of the suffix array whose longest common prefix has at least that many lines.

Each later copy of a run of at least `min_lines` lines (later: a greater document key, or further on in the same one) is deleted, the
first one stays. A place in a deeper interval is in that of min_lines too, and a run's later lines begin runs of their own there: so
the deletions of the intervals of min_lines, together, are those of all maximal runs. With `long_line`, a single line of so many words
is a run too.

Names are counted with partial sums. Names of a thousandth of all places or more are joined back by broadcast, the others in a
shuffle, so a line with a third of all places is never gathered in one task. Only the lines of one text are ever brought together.

Defined cases: the documents' order is doc_id (null first), then a hash of the text; rows with one doc_id and one text are
the same document and all get its result; a null text stays null; an empty or blank one has no lines and stays as it is;
white-space lines go with the line before them; a text whose lines all go becomes empty; an empty table gives no rows; other
columns are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_back, set_aside, stored, table

_BLANK = r"^[\x20\x09-\x0D]*$"
_KEY = ["f_id", "f_text"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the document's key: its id, with null as the smallest, and a hash of its text."""
    return docs.withColumn("f_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("f_text", F.xxhash64("text"))


def _places(docs: DataFrame, long_line: int) -> DataFrame:
    """A row per line with a word: the document's key, u its number among these, its range [i, j) of raw lines, the two halves of its id
    (c1, c2), and whether it has at least long_line words."""
    raw = _lines(F.col("text").cast("string"))
    full = F.filter(F.transform(raw, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~s["x"].rlike(_BLANK))
    wordy = lambda x: F.when(F.length(x) < 2 * long_line - 1, False).otherwise(F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) >= long_line) if long_line else F.lit(False)
    ids = F.transform(full, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("c1"), F.xxhash64(F.lit(1), s["x"]).alias("c2"), wordy(s["x"]).alias("long")))
    one = _keyed(docs).select(*_KEY, F.size(raw).alias("n"), ids.alias("full")).dropDuplicates(_KEY)  # repeated rows are one document
    one = one.select(*_KEY, "n", "full", F.posexplode_outer("full").alias("u", "s")).filter("u is not null")
    j = F.coalesce(F.get("full", F.col("u") + 1)["i"], F.col("n"))
    return one.select(*_KEY, "u", F.col("s.i").alias("i"), j.alias("j"), "s.c1", "s.c2", "s.long")


def _repeated(named: DataFrame, total: int) -> DataFrame:
    """Of places named by (c1, c2), those whose name occurs more than once, with its rank among these names, r; `first` says that it is the first
    of them. Ranks are in the order of the names: those of all places, sorted, are the suffix array as far as it is known."""
    at = F.struct(*_KEY, "u")
    names = named.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("least")).filter("n > 1")
    names = stored(names.repartitionByRange("c1", "c2").sortWithinPartitions("c1", "c2").withColumn("r", F.monotonically_increasing_id()), "ranks")
    found = join_back(named, names, ["c1", "c2"], "n", total, [*_KEY, "u"], inner=True)
    return stored(found.select(*[c for c in named.columns if c not in ("c1", "c2")], "r", (F.col("least") == at).alias("first")), "repeated")


def _doubled(places: DataFrame, more: int) -> DataFrame:
    """Names of the runs that consist of a repeated run and, `more` lines on, another one: their ranks."""
    ahead = Window.partitionBy(*_KEY).orderBy("u").rangeBetween(more, more)
    return places.select(*_KEY, "u", F.col("r").alias("c1"), F.first("r").over(ahead).alias("c2")).filter("c2 is not null")


def repeated_runs(docs: DataFrame, min_lines: int = 2, report: bool = True, long_line: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, later, longest): all lines; the places u where a later copy of a run of so many (size) lines begins, min_lines, or one of at
    least long_line words (0: none); and the number of lines of the longest repeated run that begins at a place (by rounds of doubling,
    so long as report)."""
    places = stored(_places(docs, long_line), "lines")
    total = max(1, places.count())
    level, size = _repeated(places.select(*_KEY, "u", "c1", "c2", "long"), total), 1
    levels = [(1, level)]
    single = level.filter(~F.col("first") & F.col("long")).select(*_KEY, "u", F.lit(1).alias("size"))
    while size * 2 <= min_lines:
        level = _repeated(_doubled(level, size), total)
        size *= 2
        levels.append((size, level))
    # Two overlapping runs of `size` lines make one of min_lines.
    later = level if size == min_lines else _repeated(_doubled(level, min_lines - size), total)
    later = later.filter(~F.col("first")).select(*_KEY, "u", F.lit(min_lines).alias("size"))
    while report:
        level = _repeated(_doubled(level, size), total)
        if level.isEmpty():
            break
        size *= 2
        levels.append((size, level))
    longest = levels[0][1].select(*_KEY, "u", F.lit(1).alias("lines"))
    for size, level in levels[1:]:
        longest = longest.unionByName(level.select(*_KEY, "u", F.lit(size).alias("lines")))
    return places, later.unionByName(single) if long_line else later, longest.groupBy(*_KEY, "u").agg(F.max("lines").alias("lines"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, report: bool = True, long_line: int = 0) -> DataFrame:
    """docs with the text that is left, and the columns n_lines, n_removed and longest_run: the lines with a word, those
    deleted, and the largest power of two of lines of a repeated run in the document (0 without report)."""
    docs, back = set_aside(docs, [*_KEY, "gone"])
    places, later, longest = repeated_runs(docs, min_lines, report, long_line)
    gone = later.select(*_KEY, F.explode(F.sequence("u", F.col("u") + F.col("size") - 1)).alias("u")).distinct()
    ranges = places.join(gone, [*_KEY, "u"]).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_removed"), F.flatten(F.collect_list(F.sequence("i", F.col("j") - 1))).alias("gone"))
    totals = places.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_lines"))
    facts = totals.join(ranges, _KEY, "left")
    if report:
        facts = facts.join(longest.groupBy(*_KEY).agg(F.max("lines").alias("longest_run")), _KEY, "left")
    else:
        facts = facts.withColumn("longest_run", F.lit(0))
    mine = ["n_lines", "n_removed", "longest_run"]
    out = _keyed(docs.drop(*mine)).join(facts, _KEY, "left")
    raw = _lines(F.col("text"))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col("gone")), lambda i: F.get(raw, i)), "\n")
    out = out.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in mine}).drop(*_KEY, "gone").withColumnsRenamed(back)


#: From so many words on a single line is a run of its own (in the registered query and the pipeline).
LONG_LINE = 20


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long_line=LONG_LINE)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", "longest_run", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, str_split(text, chr(10)) AS raw FROM documents),
e AS (SELECT doc_id, unnest(raw) AS x, generate_subscripts(raw, 1) - 1 AS i, len(raw) AS n FROM d),
l AS (
  SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS u,
    coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n) AS j
  FROM e WHERE NOT regexp_full_match(x, '[\x20\x09-\x0D]*')),
levels(lines, doc_id, u, name) AS (
  SELECT 1, doc_id, u, md5(x) FROM l
  UNION ALL
  SELECT * FROM (
    WITH again AS (SELECT *, count(*) OVER (PARTITION BY name) AS c FROM levels)
    SELECT a.lines * 2, a.doc_id, a.u, md5(a.name || b.name)
    FROM again a JOIN again b ON b.doc_id = a.doc_id AND b.u = a.u + a.lines
    WHERE a.c > 1 AND b.c > 1)),
named AS (
  SELECT *, count(*) OVER (PARTITION BY lines, name) AS c,
    row_number() OVER (PARTITION BY lines, name ORDER BY doc_id, u) AS place
  FROM levels),
gone AS (
  SELECT DISTINCT doc_id, u + k AS u FROM named, (VALUES (0), (1)) t(k) WHERE lines = 2 AND place > 1
  UNION SELECT doc_id, u FROM named JOIN l USING (doc_id, u) WHERE lines = 1 AND place > 1 AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 20),
kept AS (
  SELECT d.doc_id, coalesce(string_agg(e.x, chr(10) ORDER BY e.i) FILTER (WHERE g.u IS NULL), '') AS text, count(DISTINCT g.u) AS n_removed
  FROM d JOIN e USING (doc_id)
  LEFT JOIN l ON l.doc_id = e.doc_id AND e.i >= l.i AND e.i < l.j
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.u = l.u
  GROUP BY d.doc_id),
runs AS (SELECT doc_id, max(lines) AS longest_run FROM named WHERE c > 1 GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT k.doc_id, coalesce(n_lines, 0) AS n_lines, k.n_removed, coalesce(longest_run, 0)::BIGINT AS longest_run,
  length(text) AS kept_chars, sha256(text) AS kept_sha256
FROM kept k LEFT JOIN runs USING (doc_id) LEFT JOIN totals USING (doc_id)
"""

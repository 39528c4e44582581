"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

Items and documents are sets of word shingles. Items are partitioned by size (powers of two). An item's MinHash sketch is the
k smallest of its shingles' hashes, where k is one more than the number of shingles that an item of its partition may miss
at the threshold: a document that holds enough of the item must hold one of any k shingles, so the search loses nothing. A
sketch of the document would: a short item is a vanishing part of a long document. All hashes of a document are therefore
probed, in the scan, and a document with fewer shingles than an item needs is no candidate for it. Candidates are verified
by exact containment, on the shingles' words.

Sketches and items are broadcast if they have at most `broadcast_rows` rows. Beyond that, up to twenty times as many sketch hashes are
broadcast without their items, and only a document's shingles that are among them are shuffled; still larger sketches meet all shingles
in a shuffle.

Words are those of the lower-cased text without punctuation at their ends. Defined cases: a text with fewer words than a
shingle is one shingle; one without words has none, and is neither found nor a finding; different texts with one doc_id or
item_id are each searched and give the best of them; a null id is an id; repeated rows and items change nothing; other columns are ignored; an empty table
gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

_SPLIT = r"[.,;:!?\"'()\[\]{}]*[\x20\x09-\x0D]+[.,;:!?\"'()\[\]{}]*"
_ENDS = r"^[.,;:!?\"'()\[\]{}\x20\x09-\x0D]+|[.,;:!?\"'()\[\]{}\x20\x09-\x0D]+$"


def content_words(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _ENDS, "")
    return F.filter(F.split(t, _SPLIT), lambda w: w != "")


def _over_shingles(w: Column, size: int, of) -> Column:
    """An array of of([words]) for each shingle; of a shorter text for all of it, of none for nothing."""
    n = F.size(w)
    full = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: of(*[F.get(w, i + j) for j in range(size)]))
    return F.when(n >= size, full).when(n > 0, F.array(of(*[F.get(w, F.lit(j)) for j in range(size)]))).otherwise(F.slice(full, 1, 0))


def hashes(w: Column, size: int) -> Column:
    return _over_shingles(w, size, F.xxhash64)


def strings(w: Column, size: int) -> Column:
    return _over_shingles(w, size, lambda *x: F.concat_ws(" ", *x))


def _maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def findings(docs: DataFrame, items: DataFrame, shingle_words: int = 5, containment: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, c, item_id, t, n, shared) for each text that holds at least `containment` of an item's n shingles: c is its text_hash, t a hash of
    the item's shingles."""
    per_mille = round(containment * 1000)
    b = items.select("item_id", content_words(F.col("text")).alias("w"))
    b = b.select("item_id", F.array_distinct(strings(F.col("w"), shingle_words)).alias("s"), F.array_distinct(hashes(F.col("w"), shingle_words)).alias("h"))
    b = b.filter(F.size("s") > 0).withColumn("t", F.xxhash64(F.array_sort("s"))).dropDuplicates(["item_id", "t"])
    b = stored(b.select("item_id", "t", "s", "h", F.size("s").alias("n")), "items")
    largest = F.pow(F.lit(2), F.floor(F.log2(F.col("n"))) + 1).cast("int") - 1  # of the size partition
    k = F.floor(largest * (1000 - per_mille) / 1000).cast("int") + 1
    sketches = b.select("item_id", F.ceil(F.col("n") * per_mille / 1000).alias("needed"), F.explode(F.slice(F.sort_array("h"), F.lit(1), F.least(k, F.size("h")))).alias("h"))
    exact = b.select("item_id", "t", "n", F.explode("s").alias("s"))
    rows = b.agg(F.sum("n")).first()[0] or 0

    # explode_outer, as the filter that the optimizer derives from explode would compute the words again for each shingle.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("c", text_hash(F.col("text")))
    probed = d.select("doc_id", "c", content_words(F.col("text")).alias("w")).select("doc_id", "c", hashes(F.col("w"), shingle_words).alias("hs"))
    probed = probed.select("doc_id", "c", F.size("hs").alias("size"), F.explode_outer("hs").alias("h"))
    held = sketches.count()
    if broadcast_rows < held <= 20 * broadcast_rows:
        probed = probed.join(F.broadcast(sketches.select("h").distinct()), "h", "left_semi")
    hits = probed.join(_maybe_broadcast(sketches, held, broadcast_rows), "h").filter("size >= needed")
    hits = stored(hits.select("doc_id", "c", "item_id").distinct(), "candidates")

    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.c") == F.col("k.c"))
    found = d.alias("d").join(hits.select("doc_id", "c").distinct().alias("k"), same, "left_semi")
    parts = found.select("doc_id", "c", content_words(F.col("text")).alias("w")).select("doc_id", "c", F.explode_outer(F.array_distinct(strings(F.col("w"), shingle_words))).alias("s"))
    shared = parts.join(_maybe_broadcast(exact, rows, broadcast_rows), "s").groupBy("doc_id", "c", "item_id", "t", "n").agg(F.countDistinct("s").alias("shared"))
    return shared.filter(F.col("shared") * 1000 >= F.col("n") * per_mille)


def contaminated(docs: DataFrame, items: DataFrame, shingle_words: int = 5, containment: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): documents that hold at least `containment` of an item's shingles."""
    shared = findings(docs, items, shingle_words, containment, broadcast_rows)
    best = shared.groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "n")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.shared").cast("long").alias("shared"), F.col("x.n").cast("long").alias("item_shingles"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH clean AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '^[.,;:!?"''()\[\]{}\x20\x09-\x0D]+|[.,;:!?"''()\[\]{}\x20\x09-\x0D]+$', '', 'g'),
    '[.,;:!?"''()\[\]{}]*[\x20\x09-\x0D]+[.,;:!?"''()\[\]{}]*'), lambda x: x <> '') AS w FROM clean),
s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
b AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM s WHERE kind = 'b')
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, max(b.n) AS item_shingles
FROM b JOIN s d ON d.kind = 'd' AND d.s = b.s GROUP BY d.id, b.id HAVING count(*) * 1000 >= max(b.n) * 800
"""

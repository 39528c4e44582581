"""A corpus from raw documents: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; run() stores a stage's result as
Parquet in the shared folder and reads it again for the next.

Defined cases, for each stage but the last: the columns and their order stay; a null text stays null where it is not judged, and counts
as empty where it is; a null doc_id is an id, and the largest where one document of a group stays; repeated rows are each judged, are one
document in the line and near-duplicate stages, and the near-duplicate stage keeps one of them; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwright.llm import decontamination, lines, packing, simhash, toxicity
from fenwright.llm.common import set_aside, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own, back = set_aside(docs, ["score", "predicted"])
    return toxicity.score(own, model).filter("predicted = 0").drop("score", "predicted").withColumnsRenamed(back).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of runs of two lines or more, and of single lines of 20 words or more; n_chars follows the text."""
    own, back = set_aside(docs, ["n_lines", "n_removed", "longest_run"])
    out = lines.dedup_lines(own, min_lines=2, report=False, long_line=lines.LONG_LINE).drop("n_lines", "n_removed", "longest_run")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumnsRenamed(back).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; groups: five-word SimHash fingerprints within two bits, and sets of five-word
    shingles with a similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle_words=5, radius=2, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item; other texts with the id of one stay."""
    found = decontamination.findings(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "c").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (decontamination.text_hash(F.col("d.text")) == F.col("f.c"))
    return docs.alias("d").join(found.alias("f"), same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: A trained model, SimHash and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Shared pieces: table access, the folder for intermediate tables, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from spark.checkpoint.dir. Only where driver and executors are one process (a local test)
    is a temporary folder used instead; a cluster without the setting is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fenwright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage is cut, lost executors cost nothing. The plan starts anew with the
    size of the files; a checkpoint would keep the optimizer's estimate, which multiplies at each join of a loop until the driver cannot hold it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """A text's name: 127 bits of two hashes as a whole number, so that no two of 10^12 texts share one by chance."""
    high, low = F.xxhash64(text), F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 1)
    return (high.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") * 2 + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def join_back(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, spread: list[str], inner: bool = False) -> DataFrame:
    """rows with the columns of facts (a row per key; n: about how many of the `total` rows have it), without gathering the rows of a frequent key.

    Keys of at least a thousandth of the rows are a thousand at most: their facts are broadcast, and their rows, like those without a key, are
    dealt out by the columns `spread`. All others meet their facts in a shuffle; a frequent key must have facts. inner: only rows with facts. facts is read twice and should be stored."""
    cols, tag = [c for c in facts.columns if c not in keys], uuid.uuid4().hex[:8]
    salt, hot_, cold_ = f"salt_{tag}", f"hot_{tag}", f"cold_{tag}"
    often = F.col(n) * 1000 >= total
    hot = facts.filter(often).select(*keys, F.struct(*cols).alias(hot_))
    cold = facts.filter(~often).select(*keys, F.lit(0).alias(salt), F.struct(*cols).alias(cold_))
    alone = F.col(hot_).isNotNull()
    for k in keys:
        alone = alone | F.col(k).isNull()
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(alone, 1 + F.pmod(F.hash(*spread), F.lit(1 << 20))).otherwise(0))
    out = marked.join(cold, [*keys, salt], "left").withColumn(cold_, F.coalesce(hot_, cold_))
    out = out.filter(F.col(cold_).isNotNull()) if inner else out
    return out.select(*rows.columns, *[F.col(f"{cold_}.{c}").alias(c) for c in cols])


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that bear one of the names renamed, and the way back: an operator's own names can't meet those of its input."""
    own = {n.lower() for n in names}
    back = {f"own_{uuid.uuid4().hex[:8]}_{c}": c for c in df.columns if c.lower() in own}
    return df.withColumnsRenamed({c: k for k, c in back.items()}), back


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())

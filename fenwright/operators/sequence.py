"""Operators over the order of lines, rows or events. Every one takes the partition and order columns; none relies on the
order in which rows happen to come."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order)


def text_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no, line)"""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def carry_forward(df: DataFrame, value: Column, name: str, partition: list[str], order: list[str]) -> DataFrame:
    """The last value that is not null, up to and with the row."""
    w = ordered(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def look_back(df: DataFrame, value: Column, name: str, partition: list[str], order: list[str], rows: int) -> DataFrame:
    """The nearest value that is not null in the rows before."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(ordered(partition, order).rowsBetween(-rows, -1)))


def look_ahead(df: DataFrame, value: Column, name: str, partition: list[str], order: list[str], rows: int, begin: int = 1) -> DataFrame:
    """The first value that is not null in the rows from `begin` rows on."""
    return df.withColumn(name, F.first(value, ignorenulls=True).over(ordered(partition, order).rowsBetween(begin, rows)))


def islands(df: DataFrame, starts: Column, name: str, partition: list[str], order: list[str]) -> DataFrame:
    """Numbers runs of rows: a run begins where `starts` holds; rows before the first have 0."""
    w = ordered(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def blocks(df: DataFrame, starts: Column, partition: list[str], order: str, end: str) -> DataFrame:
    """Rows that begin a block, with the place of the next one in `end` (null for the last)."""
    return df.filter(starts).withColumn(end, F.lead(order).over(ordered(partition, [order])))


def chunk_rows(df: DataFrame, partition: list[str], order: list[str], rows: int = 25, overlap: int = 2) -> DataFrame:
    """A row for each chunk that holds it: chunk c holds `rows` rows from c * (rows - overlap) on; a chunk that holds only
    the overlap is not made."""
    step = rows - overlap
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    df = df.withColumn("row_no", F.row_number().over(ordered(partition, order)) - 1).withColumn("n_rows", n)
    last = F.when(F.col("n_rows") <= rows, 0).otherwise(F.ceil((F.col("n_rows") - overlap) / step) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("row_no") - rows + 1) / step))
    chunk = F.sequence(first.cast("int"), F.least(F.floor(F.col("row_no") / step), last).cast("int"))
    return df.withColumn("chunk", F.explode(chunk)).withColumn("place", F.col("row_no") - F.col("chunk") * step).drop("n_rows")


def chunk_chars(lines: Column, rows: int = 25, chars: int = 10_000, overlap: int = 2) -> Column:
    """The [begin, end) of chunks of an array of lines, limited by lines and characters; neighbours share `overlap` lines. A
    line that is too long by itself is a chunk."""
    blank = F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("done"), F.lit(0).alias("begin"), F.lit(0).alias("at"), F.lit(0).alias("chars"), F.lit(0).alias("before"), F.lit(0).alias("last"))

    def step(a: Column, s: Column) -> Column:
        n = F.length(s) + 1
        over = (a["at"] > a["begin"]) & ((a["chars"] + n > chars) | (a["at"] - a["begin"] >= rows))
        begin = F.greatest(a["at"] - overlap, a["begin"] + 1)
        kept = F.when(a["at"] - begin == overlap, a["before"] + a["last"]).when(a["at"] - begin == 1, a["last"]).otherwise(0) if overlap == 2 else F.lit(0)
        return F.struct(
            F.when(over, F.array_append(a["done"], F.struct(a["begin"].alias("begin"), a["at"].alias("end")))).otherwise(a["done"]).alias("done"),
            F.when(over, begin).otherwise(a["begin"]).alias("begin"),
            (a["at"] + 1).alias("at"),
            F.when(over, kept + n).otherwise(a["chars"] + n).alias("chars"),
            a["last"].alias("before"),
            n.alias("last"),
        )

    end = lambda a: F.when(a["at"] > a["begin"], F.array_append(a["done"], F.struct(a["begin"].alias("begin"), a["at"].alias("end")))).otherwise(a["done"])
    return F.aggregate(lines, blank, step, end)


def first_seen(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def running_total(df: DataFrame, value: Column, name: str, partition: list[str], order: list[str]) -> DataFrame:
    w = ordered(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def call_rate(df: DataFrame, key: str, ts: str, tie: str, seconds: int = 60) -> DataFrame:
    """How many calls of the key the last `seconds` hold, and the gap to the call before."""
    trailing = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    return df.withColumn("in_window", F.count(F.lit(1)).over(trailing)).withColumn("gap_us", F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")))


def unique_names(df: DataFrame, name: str, order: list[str], out: str) -> DataFrame:
    """Names made unique in order: the first row of a name keeps it, a later one gets ` (2)`, ` (3)` and so on, the next number whose name is not
    taken. Names can only meet others with the same stem, the name without such endings; a stem whose rows all have one name is numbered by a
    window, and the state of taken names is held for the other stems only, one stem at a time."""
    stem, mixed = "_stem", "_mixed"
    d = df.withColumn(stem, F.regexp_replace(F.col(name), r"( \([0-9]+\))+$", ""))
    several = d.groupBy(stem).agg((F.min(name) != F.max(name)).alias(mixed))
    d = d.join(several, stem)
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    plain = d.filter(~F.col(mixed)).withColumn(out, F.when(k == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), k.cast("string"), F.lit(")"))))

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        taken, last, made = set(), {}, []
        for x in rows[name]:
            unique = x
            while unique in taken:
                last[x] = last.get(x, 1) + 1
                unique = f"{x} ({last[x]})"
            taken.add(unique)
            made.append(unique)
        return rows.assign(**{out: made})

    schema = d.schema.add(out, "string")
    return plain.unionByName(d.filter(F.col(mixed)).groupBy(stem).applyInPandas(number, schema)).drop(stem, mixed)

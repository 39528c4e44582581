"""Extraction by a model, for documents that no layout fits. The model is a callable from text to a JSON text, so any provider, or a recorded
table of answers, can stand in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import merge
from . import sequence
from .layouts import RAW

FIELDS = ["area", "building", "floor_unit", "size", "desks", "price_pcm", "price_psf", "features", "contacts"]
ANSWER = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"


def chunks(rows: DataFrame, large_rows: int = 40, large_chars: int = 20_000) -> DataFrame:
    """(doc_id, chunk, whole, prompt): a document's rows, numbered, in one prompt (whole) or, if they are many, in overlapping chunks. rows:
    doc_id, row_idx, cells."""
    d = rows.withColumn("line", F.array_join(F.filter(F.col("cells"), lambda c: F.trim(c) != ""), " | "))
    g = d.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "line"))), lambda x: F.concat(F.lit("Row "), x["row_idx"].cast("string"), F.lit(": "), x["line"])).alias("lines"))
    chars = F.aggregate("lines", F.lit(0), lambda a, s: a + F.length(s))
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.size("lines").alias("end")))
    large = (F.size("lines") > large_rows) | (chars > large_chars)
    parts = F.when(large, sequence.chunk_chars(F.col("lines"))).otherwise(whole)
    g = g.withColumns({"parts": parts, "whole": ~large}).select("doc_id", "lines", "whole", F.posexplode("parts").alias("chunk", "p"))
    return g.select("doc_id", "chunk", "whole", F.array_join(F.slice("lines", F.col("p.begin") + 1, F.col("p.end") - F.col("p.begin")), "\n").alias("prompt"))


#: What an error says when an answer was too long for the model (fixed values).
TOO_LONG = ("not valid json", "truncated", "max_tokens", "max output", "output size")


def split_rows(lines: list[str], most_rows: int = 25, most_chars: int = 10_000, overlap: int = 2) -> list[list[str]]:
    """Overlapping parts of at most so many rows and, with their line ends, characters; a longer row is a part of its own."""
    parts, begin = [], 0
    while begin < len(lines):
        end, chars = begin, 0
        while end < len(lines) and end - begin < most_rows and (end == begin or chars + len(lines[end]) + 1 <= most_chars):
            chars += len(lines[end]) + 1
            end += 1
        parts.append(lines[begin:end])
        if end == len(lines):
            break
        begin = max(end - overlap, begin + 1)
    return parts


def _is_json(answer: str | None) -> bool:
    """Whether an answer begins, after fences and words, with a whole JSON value."""
    at = re.search(r"[\[{]", answer or "")
    try:
        return bool(at) and json.JSONDecoder().raw_decode(answer, at.start()) is not None
    except ValueError:
        return False


def ask(prompts: DataFrame, model: Callable[[str], str], most: int = 25) -> DataFrame:
    """prompts with answer and error: a failing call, a malformed answer, or a chunk of a large document with over `most` records, is a row with an
    error, and does not touch the other chunks. A malformed chunk is asked for once more; a whole document whose answer was too long is asked for
    again in chunks, in place of the one prompt."""

    def call(prompt: str, tries: int) -> tuple[str | None, str]:
        error = ""
        for _ in range(tries):
            try:
                answer = model(prompt)
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"
            if _is_json(answer):
                return answer, ""
            error = "ValueError: answer is not valid JSON"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                answer, error = call(row["prompt"], 1 if row["whole"] else 2)
                lines = re.split(r"\n(?=Row [0-9]+: )", row["prompt"])
                if error and row["whole"] and len(lines) > 1 and any(t in error.lower() for t in TOO_LONG):
                    for k, part in enumerate(split_rows(lines)):
                        answer, error = call("\n".join(part), 2)
                        out.append(row | {"chunk": k, "whole": False, "prompt": "\n".join(part), "answer": answer, "error": error})
                else:
                    out.append(row | {"answer": answer, "error": error})
            yield pd.DataFrame(out, columns=[*b.columns, "answer", "error"])

    kinds = ", ".join(f"{n} {t}" for n, t in prompts.dtypes)
    asked = prompts.mapInPandas(run, f"{kinds}, answer string, error string")
    n = F.size(merge.model_json(F.col("answer"), ANSWER))
    over = F.concat(F.lit("Chunk "), F.col("chunk").cast("string"), F.lit(" returned "), n.cast("string"), F.lit(f" records, above the safe {most}-record limit"))
    asked = asked.withColumn("error", F.when((F.col("error") == "") & ~F.col("whole") & (n > most), over).otherwise(F.col("error")))
    return asked.withColumn("answer", F.when(F.col("error") == "", F.col("answer")))


def extracted(answers: DataFrame) -> DataFrame:
    """Raw listings of answers: all records, overlaps once (the first of equal building, floor, size and price)."""
    d = answers.withColumn("rows", merge.model_json(F.col("answer"), ANSWER)).select("doc_id", "chunk", F.posexplode("rows").alias("pos", "r")).select("doc_id", "chunk", "pos", "r.*")
    d = d.fillna("", FIELDS)
    key = [F.col("doc_id"), *[F.lower(F.trim(F.col(c))) for c in ("building", "floor_unit", "size", "price_pcm")]]
    d = sequence.first_seen(d, key, ["chunk", "pos"])
    from pyspark.sql import Window

    d = d.withColumn("ordinal", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "pos")) - 1).cast("int")).withColumn("sale_price", F.lit(""))
    return d.select(*RAW)


def diagnostics(answers: DataFrame) -> DataFrame:
    """Per document: chunks that went well, numbers of those that failed, longest prompt and answer."""
    return answers.groupBy("doc_id").agg(
        F.count_if(F.col("error") == "").alias("ok"), F.sort_array(F.collect_list(F.when(F.col("error") != "", F.col("chunk")))).alias("failed"), F.max(F.length("prompt")).alias("longest_prompt"), F.coalesce(F.max(F.length("answer")), F.lit(0)).alias("longest_answer")
    )

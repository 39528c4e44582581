"""Files to the documents table. Bytes are parsed in an Arrow function, one file at a time; a file that cannot be read is a row with an
error. Everything after this is relational."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import parse_html
from .office import read_docx, read_xlsx

LINK = "struct<text:string,url:string>"
DOCUMENT = (
    "doc_id string, filename string, status string, error string, text string, html string, subject string, sender string, date string, "
    f"links array<{LINK}>, html_items array<struct<kind:string,text:string,url:string>>, tables array<array<array<string>>>, "
    f"row_links array<struct<sheet_name:string,row_number:int,row_text:string,links:array<{LINK}>>>, pages_text array<string>, sheet_names array<string>, file_date string, file_mtime_year int"
)
EMPTY = {"text": "", "html": "", "subject": "", "sender": "", "date": "", "links": [], "html_items": [], "tables": [], "row_links": [], "pages_text": [], "sheet_names": [], "file_date": ""}


def read_csv(data: bytes) -> dict:
    """UTF-8 with or without a mark, else Latin-1; rows of blank cells go."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    return {"text": "\n".join(" ".join(c for c in r if c) for r in rows), "tables": [rows] if rows else []}


def read_eml(data: bytes) -> dict:
    """The first HTML part, else the first text part."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    part = next((p for p in m.walk() if p.get_content_type() == "text/html"), None)
    head = {"subject": str(m["subject"] or ""), "sender": str(m["from"] or ""), "date": str(m["date"] or "")}
    if part is not None:
        html = part.get_content()
        page = parse_html(html)
        page.pop("images")
        return head | page | {"html": html}
    plain = next((p for p in m.walk() if p.get_content_type() == "text/plain"), None)
    return head | {"text": plain.get_content() if plain is not None else ""}


def read_html(data: bytes) -> dict:
    html = data.decode("utf-8", "replace")
    page = parse_html(html)
    page.pop("images")
    if not page["text"]:
        raise ValueError("no visible text")
    return page | {"html": html}


READERS = {"eml": read_eml, "html": read_html, "htm": read_html, "csv": read_csv, "docx": read_docx, "xlsx": read_xlsx}


def parse_file(name: str, data: bytes) -> dict:
    """The document of a file; never raises."""
    kind = posixpath.splitext(name)[1].lower().lstrip(".")
    out = {"filename": posixpath.basename(name), "status": "ok", "error": "", **EMPTY}
    if kind not in READERS:
        return out | {"status": "error", "error": f"no reader for .{kind} files"}
    try:
        return out | READERS[kind](bytes(data))
    except Exception as e:  # any malformed file is a row, not a failed job
        return out | {"status": "error", "error": f"{type(e).__name__}: {e}"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path as documents; doc_id is the file's path."""
    names = [c.strip().split(" ")[0] for c in DOCUMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse_file(p, c) | {"doc_id": p, "file_mtime_year": y} for p, c, y in zip(b["path"], b["content"], b["year"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.year("modificationTime").alias("year")).mapInPandas(run, DOCUMENT)


def documents_from_pages(pages: DataFrame) -> DataFrame:
    """Documents of texts that were extracted page by page: (doc_id, page_no, text). Empty pages keep their place."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
    d = pages.groupBy("doc_id").agg(ordered.alias("pages_text"))
    return d.withColumn("text", F.array_join(F.filter("pages_text", lambda t: t != ""), "\n"))


def table_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, table_idx, row_idx, cells)"""
    t = docs.select("doc_id", F.posexplode("tables").alias("table_idx", "rows"))
    return t.select("doc_id", "table_idx", F.posexplode("rows").alias("row_idx", "cells"))


def items(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, text, url)"""
    return docs.select("doc_id", F.posexplode("html_items").alias("pos", "i")).select("doc_id", "pos", "i.*")

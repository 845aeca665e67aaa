"""Scans and sinks: uploads as binary files, text tables, PDF decoding, JSON output."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import layout, pdf

MAX_BYTES = 50 * 1024 * 1024
PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")


def uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content) of PDF files in a folder. Name and size filters reach the scan; empty and oversized files stay out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).filter(F.col("length").between(1, max_bytes))


def rejected(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, code) of files that uploads() leaves out by size; contents aren't read. Spark's scan itself skips files of 0 bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.filter(~F.col("length").between(1, max_bytes)).select("path", "length", F.when(F.col("length") == 0, "pdf_empty_file").otherwise("pdf_too_large").alias("code"))


def metadata(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(filename, size, page_count) of uploads(); of a broken file the page objects in the clear, if any."""
    files = uploads(spark, path, max_bytes)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return decode(files, text=False).select(name.alias("filename"), F.col("length").alias("size"), "page_count")


def decoded(files: DataFrame) -> DataFrame:
    """(doc_id, text, size, page_count, elements, blocks, error) of uploads(), as analyze() reads them: a broken file has no text, and no pages but its page objects in the clear."""
    told = decode(files)
    return told.select(F.col("path").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("length").alias("size"), "page_count", "elements", "blocks", "error")


def accepted(name: str, content_type: str):
    """An upload counts as PDF by its type or by its name."""
    return (F.col(content_type) == "application/pdf") | F.lower(name).endswith(".pdf")


DECODED = "path string, length long, page_count int, text string, elements array<struct<type:string,text:string>>, blocks array<struct<kind:int,text:string>>, error string"


def decode(files: DataFrame, text: bool = True) -> DataFrame:
    """(path, length, page_count, text, elements, blocks, error) of files(path, length, content); one failing file is a row with an error, never a failed job.

    text has the blocks of all pages in reading order, an empty line between them; blocks are those of layout.blocks(), of
    kind 0; elements are the same with their types, lines joined. Without text only the pages are counted.
    """

    def read(content: bytes):
        file = pdf.File(content)
        pages = file.pages()
        if not text:
            return len(pages), None, None, None, None
        found = layout.blocks([pdf.runs(file, p) for p in pages])
        elements = [{"type": b.kind, "text": " ".join(b.text.split("\n"))} for b in found]
        return len(pages), "\n\n".join(b.text for b in found), elements, [{"kind": 0, "text": b.text} for b in found], None

    def run(batches):
        for batch in batches:
            rows = []
            for path, length, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    told = read(content or b"")
                except Exception as e:  # noqa: BLE001  a broken file is a result
                    content = content or b""
                    clear = len(PAGE.findall(content)) if content.startswith(b"%PDF") else 0  # page objects in the clear
                    told = (clear, None, None, None, f"{type(e).__name__}: {e}"[:500])
                rows.append(dict(zip(("path", "length", "page_count", "text", "elements", "blocks", "error"), (path, length, *told), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    pair = lambda key, kind: pa.list_(pa.struct([(key, kind), ("text", pa.string())]))
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("page_count", pa.int32()), ("text", pa.string()), ("elements", pair("type", pa.string())), ("blocks", pair("kind", pa.int32())), ("error", pa.string())])
    return files.select("path", "length", "content").mapInArrow(run, DECODED)


def as_json(results: DataFrame) -> DataFrame:
    """(doc_id, json): each row as the API's JSON."""
    return results.select("doc_id", F.to_json(F.struct(*[c for c in results.columns if c != "doc_id"])).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)

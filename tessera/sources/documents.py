"""Documents as text: plain text files, and PDF files through a given extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of text files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text"))


def read_pdfs(spark: SparkSession, path: str, extractor: Callable[[bytes], tuple[str, list]] | None = None) -> DataFrame:
    """doc_id, text, tables and error of PDF files. ``extractor`` takes the bytes; by default pdfplumber, if it is there."""
    schema = "doc_id string, text string, tables array<array<array<string>>>, error string"

    def plumber(content: bytes) -> tuple[str, list]:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return "\n".join(p.extract_text() or "" for p in pdf.pages), [t for p in pdf.pages for t in p.extract_tables()]

    read = extractor or plumber

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    (text, tables), error = read(content), None
                except Exception as e:  # a file that can't be read is reported, not fatal
                    text, tables, error = None, [], f"{type(e).__name__}: {e}"
                kinds = pa.schema([("doc_id", pa.string()), ("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("error", pa.string())])
                yield pa.RecordBatch.from_pylist([{"doc_id": name, "text": text, "tables": tables, "error": error}], schema=kinds)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)

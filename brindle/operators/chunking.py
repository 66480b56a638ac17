"""Overlapping token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import safe_name
from brindle.operators.providers import Tokenizer, WhiteSpace


def chunk_documents(docs: DataFrame, size: int = 250, overlap: int = 50, least_chars: int = 50, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, chunk_id, text, filename): windows of ``size`` tokens, each ``overlap`` into the last.

    Windows of ``least_chars`` characters or fewer are dropped before numbering. All windows of a document
    come from one row, so numbers and totals are worked out on its array, without a shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    out = (tokenizer or WhiteSpace()).windows(docs.select("doc_id", "filename", "text"), "text", size, overlap)
    trimmed = F.transform("parts", lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    out = out.withColumn("parts", F.filter(trimmed, lambda x: F.length(x) > least_chars))
    out = out.select("doc_id", "filename", F.size("parts").alias("total_chunks"), F.posexplode("parts").alias("chunk_index", "text"))
    name = F.coalesce(safe_name(F.col("filename")), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return out.withColumn("chunk_id", F.format_string("%s_chunk_%05d", name, F.col("chunk_index")))


def next_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst): consecutive chunks of one source, by index, then number."""
    w = Window.partitionBy("source").orderBy("chunk_index", "chunk_no")
    return chunks.where("chunk_index is not null").select(F.col("chunk_no").alias("src"), F.lead("chunk_no").over(w).alias("dst")).where("dst is not null")

"""Folder ingestion and index tables."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.arrow import column

SUFFIXES = r"\.(pdf|md|markdown|txt)$"
DOCUMENT = "path string, filename string, doc_type string, text string, error string"


def pdf_text(content: bytes) -> str:
    """Text of a PDF's pages, blank ones dropped; needs an optional PDF library."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    return "\n".join(p for p in pages if p.strip())


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a folder tree: PDF, Markdown and text files, suffixes in any case.

    A file that can't be read (bad UTF-8, broken PDF, no PDF library) becomes a reject with its error and
    stops nothing. Blank documents are dropped. A missing folder raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower("path").rlike(SUFFIXES)).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for path, content in zip(column(b, "path").to_pylist(), column(b, "content").to_pylist()):
                kind, text, error = ("pdf" if path.lower().endswith(".pdf") else "text"), None, None
                try:
                    text = pdf_text(content) if kind == "pdf" else content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                for c, v in zip(out, (path, path.rsplit("/", 1)[-1], kind, text, error)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["path", "filename", "doc_type", "text", "error"])

    every = files.mapInArrow(read, DOCUMENT).persist(StorageLevel.DISK_ONLY)  # two outputs, one reading
    good = every.where(F.col("error").isNull() & F.col("text").rlike(r"\S")).drop("error")
    return good, every.where(F.col("error").isNotNull()).select("path", "error")


def write_index(tables: dict[str, DataFrame], folder: str, force: bool = False) -> bool:
    """Write index tables as Parquet. Skipped (False) where all exist already, unless forced."""
    spark = next(iter(tables.values())).sparkSession
    if not force and all(complete(spark, f"{folder}/{name}") for name in tables):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def read_index(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """An index table; with ``schema``, an empty table where it is missing or its first row can't be read, else an error."""
    try:
        df = spark.read.parquet(f"{folder}/{name}")
        if schema is not None:
            df.head(1)
        return df
    except AnalysisException:
        if schema is None:
            raise FileNotFoundError(f"no index table {name} in {folder}") from None
    except (PySparkException, Py4JJavaError) as e:
        if schema is None:
            raise OSError(f"index table {name} in {folder} can't be read") from e
    return spark.createDataFrame([], schema)


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files below a path: another stamp, another content."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(out)).encode()).hexdigest()


def in_order(documents: DataFrame, by: str = "path") -> DataFrame:
    """``documents`` with ``ordinal`` BIGINT, from 0 in the order of ``by``: ranges are sorted apart, and only their sizes pass the driver."""
    from pyspark.sql import Window

    ranged = documents.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()).persist()
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    starts = F.broadcast(documents.sparkSession.createDataFrame(rows or [(0, 0)], "_part int, _before long"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return ranged.withColumn("_place", place).join(starts, "_part").withColumn("ordinal", F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")

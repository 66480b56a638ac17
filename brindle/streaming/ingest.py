"""Incremental ingestion: new documents become chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from brindle.operators.chunking import chunk_documents
from brindle.sources.files import exists


def document_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Parquet files dropped into a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_chunks(documents: DataFrame, size: int = 250, overlap: int = 50) -> DataFrame:
    """Chunks of a stream of documents; stateless, so nothing has to be kept between batches.

    Whether a document was seen before is left to ``append_chunks``, which drops known ones.
    """
    return chunk_documents(documents, size, overlap)


def append_chunks(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's chunks to a Parquet table, once each by (doc_id, chunk_index), whichever batch they came in first.

    A batch that is tried again replaces what it wrote before. Of the table only the two key columns are read.
    """
    keys = ["doc_id", "chunk_index"]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates(keys)
        if exists(spark, target):
            held = spark.read.parquet(target).where(F.col("epoch") != epoch).select(*keys)
            own = own.join(held, keys, "left_anti")
        own.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(target)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hits_per_window(hits: DataFrame, late: str = "7 days", size: str = "1 day") -> DataFrame:
    """Hits and distinct runs by day of ``hit_at``, with a watermark for rows that arrive days late."""
    timed = hits.withColumn("hit_at", F.col("hit_at").cast("timestamp")).withWatermark("hit_at", late)
    return timed.groupBy(F.window("hit_at", size).alias("w")).agg(F.count("*").alias("hits"), F.approx_count_distinct("run_id").alias("runs")).select(F.col("w.start").alias("day"), "hits", "runs")

"""Queries of the training-data operators, by problem, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import encode, forest, mix, neardup, quality, scans, sentences, split
from brindle.plans.physical import spread, table


def _near_chunks(spark: SparkSession, d: str):
    return neardup.similar_texts(spread(table(spark, d, "chunks").select("chunk_no", "text"), "chunk_no"), "chunk_no", words=3, threshold=0.5, least_words=40)


def _near_names(spark: SparkSession, d: str):
    names = table(spark, d, "documents").select("doc_id", neardup.file_stem(F.col("filename")).alias("stem"))
    return neardup.similar_strings(names, "doc_id", "stem", threshold=0.85)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    texts = neardup.unfold(*_near_chunks(spark, d)).select(F.lit("chunks.text").alias("field"), "id_a", "id_b")
    names = neardup.unfold(*_near_names(spark, d)).select(F.lit("documents.filename").alias("field"), "id_a", "id_b")
    return texts.unionByName(names)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    texts = neardup.classes(*_near_chunks(spark, d)).withColumn("field", F.lit("chunks.text"))
    return texts.unionByName(neardup.classes(*_near_names(spark, d)).withColumn("field", F.lit("documents.filename")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    return quality.text_statistics(docs, "doc_id").where("form != 'prose'").select("doc_id", "form")


def p2_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    chunks = spread(table(spark, d, "chunks").select("chunk_no", "text"), "chunk_no")
    parts, counts = [], quality.unit_counts(docs)
    for name, df, key, lang in (("documents", docs, "doc_id", "lang"), ("chunks", chunks, "chunk_no", None)):
        parts.append(quality.text_statistics(df, key, lang=lang, counts=counts).withColumnRenamed(key, "item_id").withColumn("item_table", F.lit(name)))
    return parts[0].unionByName(parts[1])


def _near_vectors(spark: SparkSession, d: str, least: float | None):
    vectors = spread(table(spark, d, "vector_store").select("vec_id", "embeddings"), "vec_id")
    return forest.close_pairs(vectors, "vec_id", "embeddings", least=least)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = forest.nearest(*_near_vectors(spark, d, 0.9))
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other vectors of every usable vector, however similar they are."""
    ids = table(spark, d, "vector_store").select("vec_id", "chunk_id")
    lists = forest.nearest_lists(*_near_vectors(spark, d, None)).join(ids, F.col("id") == F.col("vec_id"))
    near = lists.select("vec_id", "chunk_id", F.posexplode("near").alias("place", "x"))
    near = near.select("vec_id", "chunk_id", "x.neighbour", "x.cosine", (F.col("place") + 1).alias("rank"))
    near = near.join(ids.select(F.col("vec_id").alias("neighbour"), F.col("chunk_id").alias("neighbour_chunk_id")), "neighbour")
    return near.select("vec_id", "chunk_id", "neighbour", "neighbour_chunk_id", "cosine", "rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d, split.split_items).select("item_table", "item_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d, split.split_pieces)


def _oversized(spark: SparkSession, d: str, operator) -> DataFrame:
    parts = []
    for name, key in (("documents", "doc_id"), ("chunks", "chunk_no")):
        long = spread(table(spark, d, name).select(F.col(key).alias("item_id"), "text").where(F.length("text") > split.LIMIT), "item_id")
        parts.append(operator(long, "item_id").withColumn("item_table", F.lit(name)))
    return parts[0].unionByName(parts[1])


def _scan_reader(spark: SparkSession, d: str):
    return scans.fit_reader(table(spark, d, "documents"), table(spark, d, "proofread_pages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return scans.find_noise(docs, _scan_reader(spark, d), "doc_id")


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return scans.repair(docs, _scan_reader(spark, d), "doc_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    wanted = docs.join(table(spark, d, "segment_tasks").select("doc_id"), "doc_id", "left_semi")
    return sentences.split_sentences(spread(wanted, "doc_id"), sentences.fit(docs), "doc_id").select("doc_id", "sent_end")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sentences.split_sentences(spread(docs, "doc_id"), sentences.fit(docs), "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_stats, p3_found, p3_nearest, p4_found, p4_pieces, p5_found, p5_pages, p6_ids, p7_mix, p7_report, p8_found, p8_sentences)}

SQL = {
    "p4_found": r"""
        WITH items AS (
            SELECT 'documents' AS item_table, doc_id AS item_id, text FROM documents WHERE length(text) > 2000
            UNION ALL SELECT 'chunks', chunk_no, text FROM chunks WHERE length(text) > 2000)
        SELECT item_table, item_id,
               CASE WHEN list_max(list_transform(regexp_split_to_array(text,
                   '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？।؟]'),
                   lambda x: length(x))) > 2000 THEN 'forced' ELSE 'natural' END AS cut
        FROM items""",
}

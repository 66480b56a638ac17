"""``python -m brindle ingest FOLDER INDEX [--force]``, ``query INDEX TEXT``, ``compare INDEX TEXT``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import preview
from brindle.operators.index import Index, ingest
from brindle.sources.files import in_order, read_folder


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brindle")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("folder"), one.add_argument("index"), one.add_argument("--force", action="store_true")
    for name in ("query", "compare"):
        one = sub.add_parser(name)
        one.add_argument("index"), one.add_argument("text"), one.add_argument("-k", type=int, default=5)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("brindle").getOrCreate()
    if given.command == "ingest":
        documents, rejects = read_folder(spark, given.folder)
        built = ingest(in_order(documents).withColumnRenamed("ordinal", "doc_id"), given.index, given.force)
        for r in rejects.limit(20).toLocalIterator():
            print(f"left out {r.path}: {r.error}")
        print(f"{Index(spark, given.index).count('chunks')} chunks indexed" if built else "the index is there already; --force builds it anew")
        return 0
    index, asked = Index(spark, given.index), spark.createDataFrame([(1, given.text)], "query_id long, query string")
    if given.command == "query":
        shown = [("results", index.retrieve(asked, given.k).select("rank", "filename", "chunk_index", "rrf_score", F.array_join("found_in", ",").alias("found_in"), preview(F.col("text")).alias("preview")))]
    else:
        both, graph, rate = index.compare(asked, given.k)
        shown = [(n, index.payload(x).select("rank", "filename", "chunk_index", "rrf_score", preview(F.col("text")).alias("preview"))) for n, x in (("vector and keywords", both), ("graph", graph))]
        shown.append(("agreement", rate.select("n_a", "n_b", "overlap", "rate")))
    for name, df in shown:
        print(name)
        (df.orderBy("rank") if "rank" in df.columns else df).show(given.k, truncate=75)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

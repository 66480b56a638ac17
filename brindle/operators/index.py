"""Stored indexes of chunks: built once, queried many times."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import chunking, retrieval as R
from brindle.operators.providers import DEFAULTS, Providers
from brindle.sources import files

VERSION = 1  # of the tables' contents: to be raised when what is written changes
CHUNK = "chunk_no long, chunk_id string, text string, source string, filename string, doc_type string, chunk_index int, total_chunks int"
SCHEMAS = {
    "chunks": CHUNK,
    "postings": "term string, chunk_no long, tf long, dl int",
    "terms": "term string, df long, idf double",
    "corpus": "n long, avgdl double",
    "vectors": "chunk_no long, v array<double>",
    "edges": "chunk_no long, sid string, label string, count long",
    "nodes": "sid string, label string, degree long",
    "next": "src long, dst long",
}
GRAPH = ("edges", "nodes", "next")


def tables_of(chunks: DataFrame, providers: Providers = DEFAULTS) -> dict[str, DataFrame]:
    """The index tables of chunks (chunk_no, text, and of CHUNK what there is), nothing written yet."""
    whole = chunks.select(*[(F.col(c) if c in chunks.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (x.split() for x in CHUNK.split(", "))])
    posts = R.postings(whole)
    corpus = R.corpus_stats(whole)
    edges = R.contains_edges(whole, providers)
    return {
        "chunks": whole, "postings": posts, "terms": R.terms(posts, corpus), "corpus": corpus, "vectors": providers.encoder.vectors(whole, "chunk_no", "text"),
        "edges": edges, "nodes": R.nodes(edges), "next": chunking.next_edges(whole),
    }


def build_indexes(chunks: DataFrame, folder: str, force: bool = False, providers: Providers = DEFAULTS, only: tuple[str, ...] | None = None) -> bool:
    """Write the index tables of ``chunks`` below ``folder``, all, or of ``only`` those named what isn't there; False, and nothing done, where they are all there and ``force`` isn't set.

    Terms and nodes are worked out from the postings and edges as written, so the texts are read once for
    each kind of index. Postings and edges are sorted by term and signal, so a search for a few reads few row groups.
    """
    spark = chunks.sparkSession
    wanted = {name for name in only or SCHEMAS if force or not files.complete(spark, f"{folder}/{name}")}
    if not wanted:
        return False
    wanted = wanted if only else set(SCHEMAS)  # what an interrupted run left isn't mixed with new tables

    t = tables_of(chunks, providers)

    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")

    def stored(name: str, order: str | None = None) -> DataFrame:
        if name in wanted or not files.complete(spark, f"{folder}/{name}"):
            write(name, t[name].sortWithinPartitions(order) if order else t[name])
        return spark.read.parquet(f"{folder}/{name}")

    def keywords() -> None:
        posts, corpus = stored("postings", "term"), stored("corpus")
        if "terms" in wanted:
            write("terms", R.terms(posts, corpus))

    def graph() -> None:
        edges = stored("edges", "sid")
        if "nodes" in wanted:
            write("nodes", R.nodes(edges))

    with ThreadPoolExecutor(4) as side:  # the kinds of index don't wait for one another
        jobs = [side.submit(f) for f, names in ((keywords, {"postings", "corpus", "terms"}), (graph, {"edges", "nodes"})) if wanted & names]
        jobs += [side.submit(write, name, t[name]) for name in ("vectors", "chunks", "next") if name in wanted]
        for j in jobs:
            j.result()
    return True


def ingest(documents: DataFrame, folder: str, force: bool = False, size: int = 250, overlap: int = 50, providers: Providers = DEFAULTS) -> bool:
    """Documents (doc_id, path, filename, doc_type, text) to chunks to indexes; chunk numbers follow doc_id and place."""
    chunks = chunking.chunk_documents(documents, size, overlap, tokenizer=providers.tokenizer)
    extra = documents.select("doc_id", F.col("path").alias("source"), "doc_type")
    chunks = chunks.join(extra, "doc_id").withColumn("chunk_no", F.col("doc_id") * 1_000_000 + F.col("chunk_index"))
    return build_indexes(chunks, folder, force, providers)


@dataclass
class Index:
    """Opens the tables below a folder. Without a readable graph its leg finds nothing; another missing table is an error.

    With ``chunks``, a table that isn't there is built of them when it is first opened, so what nothing asks for isn't built.
    With ``from_texts`` too, a graph search doesn't build all edges where they aren't there: it takes those of the queries' signals from the texts.
    """

    spark: SparkSession
    folder: str
    providers: Providers = DEFAULTS
    chunks: DataFrame | None = None
    from_texts: bool = False
    opened: dict[str, DataFrame] = field(default_factory=dict)
    met: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)  # signals looked for in the texts, and their edges

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            if self.chunks is not None:
                build_indexes(self.chunks, self.folder, providers=self.providers, only=(name,))
            self.opened[name] = files.read_index(self.spark, self.folder, name, SCHEMAS[name] if name in GRAPH else None)
        return self.opened[name]

    def count(self, name: str = "vectors") -> int:
        return self.table(name).count()

    def is_empty(self, name: str = "vectors") -> bool:
        return self.table(name).isEmpty()

    def bm25(self, queries: DataFrame, k: int = 20) -> DataFrame:
        return R.bm25_hits(self.table("postings"), self.table("terms"), self.table("corpus"), queries, k)

    def vector(self, queries: DataFrame, k: int = 20) -> DataFrame:
        return R.vector_hits(self.table("vectors"), self.providers.encoder.vectors(queries, "query_id", "query"), k, self.providers.encoder.dim)

    def graph(self, queries: DataFrame, k: int = 20) -> DataFrame:
        if self.chunks is not None and self.from_texts and not files.complete(self.spark, f"{self.folder}/edges"):
            return R.graph_hits(self.edges_of(queries), None, queries, k, self.providers)
        known = self.table("nodes") if self.chunks is None or files.complete(self.spark, f"{self.folder}/nodes") else None
        return R.graph_hits(self.table("edges"), known, queries, k, self.providers)

    def edges_of(self, queries: DataFrame) -> DataFrame:
        """(sid, chunk_no): all edges of the queries' signals, and of those asked before, which aren't looked for again."""
        sids = R.signals_of(queries, self.providers).select("sid").distinct()
        for seen, _ in self.met:
            sids = sids.join(seen, "sid", "left_anti")
        sids = sids.persist()
        if not self.met or not sids.isEmpty():
            self.met.append((sids, R.edges_of(self.chunks, sids, self.providers).persist()))
        return reduce(DataFrame.unionByName, [edges for _, edges in self.met])

    def hybrid(self, queries: DataFrame, k: int = 5, fetch: int = 20, weights: dict[str, float] = R.WEIGHTS, vector_queries: DataFrame | None = None) -> DataFrame:
        """The three legs fused; ``vector_queries`` asks the vector leg something else instead."""
        return R.fuse(self.vector(queries if vector_queries is None else vector_queries, fetch), self.bm25(queries, fetch), self.graph(queries, fetch), k=k, weights=weights)

    def retrieve(self, queries: DataFrame, k: int = 5, fetch: int = 20, weights: dict[str, float] = R.WEIGHTS, vector_queries: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, text, source, filename, doc_type, chunk_index, scores, ranks, found_in): the payload is joined after the cut."""
        return self.payload(self.hybrid(queries, k, fetch, weights, vector_queries)).withColumn("found_in", F.split("found_in", ","))

    def payload(self, hits: DataFrame) -> DataFrame:
        return R.few(hits).join(self.table("chunks"), "chunk_no")

    def compare(self, queries: DataFrame, k: int = 5, fetch: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(vector and keyword hits, graph hits, agreement of the two)."""
        both = R.fuse(self.vector(queries, fetch), self.bm25(queries, fetch), None, k=k, weights={"vector": 0.5, "bm25": 0.5, "graph": 0.0})
        graph = R.fuse(None, None, self.graph(queries, fetch), k=k, weights={"vector": 0.0, "bm25": 0.0, "graph": 1.0}).where("graph_score > 0")
        return both, graph, R.agreement(both, graph)

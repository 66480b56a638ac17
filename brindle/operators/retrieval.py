"""Keyword, vector and graph legs, and their fusion. A batch of queries is a DataFrame (query_id, query)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import tokens
from brindle.operators.providers import DEFAULTS, Providers, cleaned

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
WEIGHTS = {"vector": 0.4, "bm25": 0.3, "graph": 0.3}
BLOCK = 2048  # queries held by a task at a time
SCORES = 2_000_000  # worked out at a time


def top(df: DataFrame, score: str, k: int, rank: str) -> DataFrame:
    """The k best chunks of each query, equal scores by chunk number; planned as a partial and a final group limit."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), "chunk_no")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` (narrow) rows, counted first; else as it is."""
    df = df.persist()
    small = df.count() <= most
    return F.broadcast(df) if small else df


def count_in_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, items ARRAY<STRING>) to (item, key, n, size): each row's items counted within the row, without a shuffle; size is the number of its items.

    Counted on the row's sorted array in the JVM, a row at a time: a batch of rows with hundreds of items each would fill a Python worker.
    """
    items = next(c for c in df.columns if c != key)
    rows = df.select(F.col(key).alias("key"), F.sort_array(items).alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))  # where runs of equal items begin
    rows = rows.select("key", "s", F.when(F.size("s") > 0, first).alias("at"))
    runs = F.transform("at", lambda i, k: F.struct(F.get("s", i).alias("item"), (F.coalesce(F.get("at", k + 1), F.size("s")) - i).cast("long").alias("n")))
    return rows.select("key", F.size("s").alias("size"), F.explode(runs).alias("x")).select("x.item", "key", "x.n", "size")


# -- keyword leg -------------------------------------------------------------------------------------


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_no, tf, dl), a row for each distinct term of a chunk; counted within the chunk's row."""
    t = chunks.where("text is not null").select("chunk_no", tokens(F.col("text")).alias("t"))
    return count_in_rows(t, "chunk_no").toDF("term", "chunk_no", "tf", "dl")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    sizes = chunks.where("text is not null").select(F.size(tokens(F.col("text"))).alias("dl"))
    return sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def terms(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): a negative idf becomes a quarter of the vocabulary's mean idf."""
    df = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n")))  # one row
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf0"))
    mean = raw.agg(F.avg("idf0").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf0") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf0")).alias("idf"))


def bm25_hits(posts: DataFrame, vocabulary: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, chunk_no, bm25_score_raw, bm25_score, bm25_rank): the k best with a positive score; bm25_score is relative to the query's best.

    The queries' terms, with their idf, go to the postings, not the postings to them: those are read once, without a shuffle.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("m"))
    asked = few(vocabulary.join(few(asked), "term").select("query_id", "term", (F.col("m") * F.col("idf")).alias("w")))
    hits = posts.join(asked, "term").crossJoin(F.broadcast(stats.select("avgdl")))  # one row
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "chunk_no").agg(F.sum(part).alias("score")).where(F.round("score", 9) > 0)
    best = top(scored, "score", k, "bm25_rank")
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    return best.select("query_id", "chunk_no", F.col("score").alias("bm25_score_raw"), share.alias("bm25_score"), "bm25_rank")


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``bm25_hits`` of chunks that have no stored index."""
    posts, stats = postings(chunks), corpus_stats(chunks)
    return bm25_hits(posts, terms(posts, stats), stats, queries, k)


# -- vector leg --------------------------------------------------------------------------------------


def _matrix(v: pa.Array, ids: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit rows) of the usable vectors."""
    at = v.offsets.to_numpy()
    right = np.flatnonzero((np.diff(at) == dim) & v.is_valid().to_numpy(zero_copy_only=False))
    flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null elements become NaN
    x = flat[at[right][:, None] + np.arange(dim)] if len(right) else np.zeros((0, dim))
    norm = np.linalg.norm(x, axis=1)
    keep = np.isfinite(norm) & (norm > 0)
    return ids[right][keep], x[keep] / norm[keep, None]


class _Best:
    """The k best of what queries have met so far; equal scores (to nine places) by id."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.ids, self.scores = np.zeros((len(q_ids), 0), np.int64), np.zeros((len(q_ids), 0))

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.q_ids):
            return
        if len(ids) > (most := max(8 * self.k, SCORES // len(self.q_ids))):
            for i in range(0, len(ids), most):
                self.meet(ids[i : i + most], x[i : i + most])
            return
        s = self.q @ x.T
        if len(ids) > 4 * self.k:  # all that reach the k-th best score, ties included
            near = np.round(s, 9)
            bound = np.partition(near, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            wide = int((near >= bound[:, None]).sum(axis=1).max())
            take = np.argpartition(-near, min(wide, len(ids) - 1), axis=1)[:, :wide]
            s, new = np.take_along_axis(s, take, 1), ids[take]
        else:
            new = np.broadcast_to(ids, s.shape)
        every, names = np.concatenate([self.scores, s], axis=1), np.concatenate([self.ids, new], axis=1)
        order = np.lexsort((names, -np.round(every, 9)), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)

    def batch(self) -> pa.RecordBatch:
        n = self.ids.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.q_ids, n)), pa.array(self.ids.reshape(-1)), pa.array(self.scores.reshape(-1))], ["query_id", "chunk_no", "score"])


TILE = 32_768  # vectors of a tile where queries are too many to be sent to every task


def knn(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, chunk_no, score, rank): exact cosine neighbours of the query vectors (query_id, v) among (chunk_no, v).

    Up to BLOCK queries are sent to all tasks and the vectors read once, where they lie; each task keeps
    one running list of the k best. More queries are parted into blocks of BLOCK and the vectors, by the
    hash of their id, into tiles of about TILE; every block meets every tile in some task, and neither passes
    the driver. Vectors of another length, with nulls or without direction are left out.
    """
    spark = vectors.sparkSession
    asked = queries.select("query_id", "v").where("v is not null").persist()
    n = asked.count()
    shape = "query_id long, chunk_no long, score double"
    if n <= BLOCK:
        rows = asked.toArrow().combine_chunks().to_batches()
        shared = spark.sparkContext.broadcast(_matrix(rows[0].column(1), rows[0].column(0).to_numpy(), dim) if rows else (np.zeros(0, np.int64), np.zeros((0, dim))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(*shared.value, k)
            for b in batches:
                best.meet(*_matrix(b.column(1), b.column(0).to_numpy(), dim))
            yield best.batch()

        return top(vectors.select("chunk_no", "v").where("v is not null").mapInArrow(scan, shape), "score", k, "rank")

    tiles, blocks = max(1, -(-vectors.count() // TILE)), -(-n // BLOCK)

    def sent(mine: int, others: int, role: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x = _matrix(b.column(1), b.column(0).to_numpy(), dim)
                place = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % mine
                for p in np.unique(place):
                    own = place == p
                    for o in range(others):
                        tile, block = (p, o) if role == 0 else (o, p)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{tile}/{block}"]), pa.array([role], pa.int32()), pa.array([ids[own].tolist()], pa.list_(pa.int64())), pa.array([x[own].tobytes()], pa.binary())], ["cell", "role", "ids", "blob"])

        return run

    cell = "cell string, role int, ids array<long>, blob binary"
    # the queries come first and stay; the tile's vectors pass by
    parts = asked.mapInArrow(sent(blocks, tiles, 1), cell).withColumn("role", F.lit(0)).unionByName(vectors.select("chunk_no", "v").where("v is not null").mapInArrow(sent(tiles, blocks, 0), cell).withColumn("role", F.lit(1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["cell"] != cell:
                    if best is not None:
                        yield best.batch()
                    cell, held, best = r["cell"], [], None
                ids, x = np.array(r["ids"], np.int64), np.frombuffer(r["blob"]).reshape(-1, dim)
                if r["role"] == 0:
                    held.append((ids, x))
                elif held:
                    best = best or _Best(np.concatenate([i for i, _ in held]), np.concatenate([y for _, y in held]), k)
                    best.meet(ids, x)
        if best is not None:
            yield best.batch()

    met = parts.repartition(min(tiles * blocks, 10 * max(200, spark.sparkContext.defaultParallelism)), "cell").sortWithinPartitions("cell", "role").mapInArrow(compare, shape)
    return top(met, "score", k, "rank")



def vector_hits(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    near = knn(vectors, queries, k, dim)
    return near.select("query_id", "chunk_no", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = 20, providers: Providers = DEFAULTS) -> DataFrame:
    encode = providers.encoder.vectors
    return vector_hits(encode(chunks, "chunk_no", "text"), encode(queries, "query_id", "query"), k, providers.encoder.dim)


# -- graph leg ---------------------------------------------------------------------------------------


def contains_edges(chunks: DataFrame, providers: Providers = DEFAULTS) -> DataFrame:
    """(chunk_no, sid, label, count): signals of each chunk, counted within its row."""
    rows = cleaned(chunks, "chunk_no", F.col("text"), False, providers.extractor)
    packed = rows.select("chunk_no", F.transform("s", lambda x: F.concat(F.coalesce(x.label, F.lit("")), F.lit("\x1f"), x.sid)).alias("s"))
    counted = count_in_rows(packed, "chunk_no")
    parts = F.split("item", "\x1f", 2)
    return counted.select(F.col("key").alias("chunk_no"), parts[1].alias("sid"), F.nullif(parts[0], F.lit("")).alias("label"), F.col("n").alias("count"))


def nodes(edges: DataFrame) -> DataFrame:
    """(sid, label, degree): entity and concept nodes with the label of the first chunk that has one, and how many chunks have them."""
    return edges.groupBy("sid").agg(F.min_by("label", "chunk_no").alias("label"), F.count("*").alias("degree"))


def signals_of(queries: DataFrame, providers: Providers = DEFAULTS) -> DataFrame:
    """(query_id, sid): the distinct signals of each query."""
    return cleaned(queries, "query_id", F.col("query"), True, providers.extractor).select("query_id", F.explode(F.array_distinct(F.transform("s", lambda x: x.sid))).alias("sid"))


MARKS = 20_000  # signals that are told by their words' hash


def edges_of(chunks: DataFrame, sids: DataFrame, providers: Providers = DEFAULTS) -> DataFrame:
    """(sid, chunk_no): all edges of the signals ``sids`` (sid, each once). The texts are read once; edges of other signals are neither sorted, shuffled nor written.

    An extractor with ``likely`` is told the signals' hashes, unless there are more than MARKS, and needn't make the other signals.
    """
    sids, extractor = few(sids), providers.extractor
    marks = [r[0] for r in sids.select(extractor.mark(F.col("sid"))).limit(MARKS + 1).collect()] if hasattr(extractor, "likely") else []
    all_of = lambda text: F.transform(extractor.signals(text), lambda x: x.sid)
    some_of = lambda text: extractor.likely(text, marks)
    rows = cleaned(chunks, "chunk_no", F.col("text"), False, some_of if 0 < len(marks) <= MARKS else all_of)
    return rows.select("chunk_no", F.explode(F.array_distinct("s")).alias("sid")).join(sids, "sid").select("sid", "chunk_no")


def graph_hits(edges: DataFrame, known: DataFrame | None, queries: DataFrame, k: int = 20, providers: Providers = DEFAULTS) -> DataFrame:
    """(query_id, chunk_no, graph_score, graph_rank): share of the weight 1/ln(1+degree) of the query's signals that a chunk has.

    The queries' signals, weighted, go to the edges, which are read once, without a shuffle. Without the ``known`` nodes
    the signals' degrees are counted on the edges first, so that no node is made that no query asks for.
    """
    asked = few(signals_of(queries, providers))
    if known is None:
        known = few(edges.select("sid").join(few(asked.select("sid").distinct()), "sid").groupBy("sid").agg(F.count("*").alias("degree")))
    weighed = few(known.join(asked, "sid").select("query_id", "sid", (1 / F.log1p(F.col("degree").cast("double"))).alias("idf")))
    total = weighed.groupBy("query_id").agg(F.sum("idf").alias("total"))
    matched = edges.select("sid", "chunk_no").join(weighed, "sid").groupBy("query_id", "chunk_no").agg(F.sum("idf").alias("got"))
    scored = matched.join(total, "query_id").select("query_id", "chunk_no", F.round(F.col("got") / F.col("total"), 6).alias("graph_score"))
    return top(scored, "graph_score", k, "graph_rank")


def graph_search(chunks: DataFrame, queries: DataFrame, k: int = 20, providers: Providers = DEFAULTS) -> DataFrame:
    """``graph_hits`` of chunks that have no stored graph."""
    edges = edges_of(chunks, signals_of(queries, providers).select("sid").distinct(), providers).persist()
    return graph_hits(edges, None, queries, k, providers)


# -- fusion ------------------------------------------------------------------------------------------


def fuse(vector: DataFrame | None, bm25: DataFrame | None, graph: DataFrame | None, k: int = 5, weights: dict[str, float] = WEIGHTS, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion: one union and one aggregation instead of two outer joins.

    Ties go to the vector list's order, then the keyword list's, then the graph's. Rows carry ids and
    scores only; texts are joined after the cut. A leg that is None, for it can't reach the result, has no hits.
    """
    none = F.lit(None)
    legs = {"vector": vector, "bm25": bm25, "graph": graph}
    rows = None
    for name, df in legs.items():
        if df is None:
            continue
        cols = ["query_id", "chunk_no"]
        for n in legs:
            mine = n == name
            cols += [(F.col(f"{n}_score") if mine else none.cast("double")).alias(f"{n}_score"), (F.col(f"{n}_rank") if mine else none.cast("int")).alias(f"{n}_rank")]
        part = df.select(*cols)
        rows = part if rows is None else rows.unionByName(part)
    one = rows.groupBy("query_id", "chunk_no").agg(*[F.max(c).alias(c) for n in legs for c in (f"{n}_score", f"{n}_rank")])
    rrf = F.lit(0.0)
    for n in legs:
        rrf = rrf + F.coalesce(F.lit(weights[n]) / (rrf_k + F.col(f"{n}_rank")), F.lit(0.0))
    found = F.filter(F.array(*[F.when(F.col(f"{n}_rank").isNotNull(), n) for n in legs]), lambda x: x.isNotNull())
    source = F.when(F.col("vector_rank").isNotNull(), 0).when(F.col("bm25_rank").isNotNull(), 1).otherwise(2)
    first = F.coalesce("vector_rank", "bm25_rank", "graph_rank")
    one = one.withColumn("rrf", rrf).withColumn("found_in", F.array_join(found, ","))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), source, first, "chunk_no")
    one = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    scores = [F.round(F.coalesce(f"{n}_score", F.lit(0.0)), 6).alias(f"{n}_score") for n in legs]
    return one.select("query_id", "chunk_no", "rank", F.round("rrf", 6).alias("rrf_score"), *scores, *[f"{n}_rank" for n in legs], "found_in")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, n_a, n_b, overlap, rate): common chunks of two result lists over the longer list's length, in per cent."""
    both = a.select("query_id", "chunk_no", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("query_id", "chunk_no", F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy("query_id", "chunk_no").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = each.groupBy("query_id").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("overlap"))
    return out.withColumn("rate", F.round(F.col("overlap") * 100.0 / F.greatest("n_a", "n_b", F.lit(1)), 6))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Results of several sub-questions (query_id, sub, rank, chunk_no, score) as one list: the last hit's payload, the first one's place."""
    place = F.col("sub") * 1000 + F.col("rank")
    one = hits.withColumn("place", place).groupBy("query_id", "chunk_no").agg(F.max_by("score", "place").alias("score"), F.min("place").alias("place"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "chunk_no"))).drop("place")

"""Questions to answers: routed, retrieved, reranked, gated, asked again, answered from sources and checked. Every step takes all questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import answers as A, models, retrieval as R
from brindle.operators.index import Index
from brindle.operators.models import Model
from brindle.plans.physical import cut_lineage

PARTS = 1000  # sub-questions of a question at most, for their ids
REFUSED = "Nothing in the documents answers this question."
WITHHELD = "An answer was found but not borne out by its sources, so it is withheld."


def merge(state: DataFrame, changes: DataFrame, key: str = "query_id") -> DataFrame:
    """``state`` with the columns of ``changes``: where a row has a change its values are taken, null ones too, others stay."""
    new = [c for c in changes.columns if c != key]
    marked = changes.select(key, *[F.col(c).alias(f"_{c}") for c in new], F.lit(True).alias("_changed"))
    both = state.join(marked, key, "left")
    columns = [F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns]
    return both.select(*columns, *[F.col(f"_{c}").alias(c) for c in new if c not in state.columns])


def retrieve_for(index: Index, queries: DataFrame, model: Model, k: int, fetch: int) -> DataFrame:
    """(query_id, chunk_no, place): hybrid hits, the vector leg asked a passage that the model thinks up."""
    return index.hybrid(queries, k, fetch, vector_queries=models.hypothetical(queries, model)).select("query_id", "chunk_no", F.col("rank").alias("place"))


def retrieve_parts(index: Index, queries: DataFrame, model: Model, k: int, fetch: int) -> DataFrame:
    """(query_id, chunk_no, place): hits of the parts that the model cuts each query into, as one list."""
    parts = models.decomposed(queries, model).where(F.col("sub") < PARTS)
    asked = cut_lineage(parts.select((F.col("query_id") * PARTS + F.col("sub")).alias("query_id"), F.col("question").alias("query")))
    hits = retrieve_for(index, asked, model, k, fetch)
    hits = hits.select(F.floor(F.col("query_id") / PARTS).alias("query_id"), F.pmod("query_id", F.lit(PARTS)).alias("sub"), F.col("place").alias("rank"), "chunk_no", F.lit(0.0).alias("score"))
    return R.distinct_hits(hits).select("query_id", "chunk_no", F.col("rank").alias("place"))


def rerank(index: Index, queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(query_id, query, rank, chunk_id, text, rerank_score)."""
    s = R.few(hits).join(index.table("chunks").select("chunk_no", "chunk_id", "text"), "chunk_no").join(R.few(queries), "query_id")
    s = s.withColumn("rerank_score", index.providers.reranker.score(F.col("query"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place", "chunk_no")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "query", "rank", "chunk_id", "text", "rerank_score")


def answer_queries(index: Index, queries: DataFrame, model: Model, k: int = 5, fetch: int = 20, rounds: int = 2) -> DataFrame:
    """(query_id, route, retries, answer, citations ARRAY<STRING>, confidence) of queries (query_id, query).

    ``direct`` questions go to the model alone; ``complex`` ones are cut into parts first. Hits are reranked
    against the question as asked last and gated; what the gate sends back is worded anew from the original
    question and searched for as a whole, ``rounds`` times at most. What passes is answered from its
    sources and checked: an answer that says the sources don't do, or that the check rejects, is refused.
    """
    routed = cut_lineage(models.routed(queries, model))
    direct = models.direct(routed.where("route = 'direct'"), model).select("query_id", F.lit("direct").alias("route"), F.lit(0).alias("retries"), "answer", F.array().cast("array<string>").alias("citations"), F.lit("pass").alias("confidence"))
    open_ = routed.where("route != 'direct'").select("query_id", "query", F.col("query").alias("original"), "route")
    passed = refused = None
    for i in range(rounds + 1):
        own = open_.select("query_id", "query")
        if i == 0:
            whole = retrieve_for(index, open_.where("route = 'simple'").select("query_id", "query"), model, k, fetch)
            hits = whole.unionByName(retrieve_parts(index, open_.where("route = 'complex'").select("query_id", "query"), model, k, fetch))
        else:
            hits = retrieve_for(index, own, model, k, fetch)
        ranked = cut_lineage(rerank(index, own, hits, k))
        best = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("rerank_score"))).alias("s"), F.count("*").alias("n"))
        gated = cut_lineage(merge(open_, best).withColumn("decision", A.gate(F.col("s"), F.col("n"))))
        kept = ranked.join(gated.where("decision = 'pass'").select("query_id", "route", F.lit(i).alias("retries")), "query_id")
        passed = kept if passed is None else passed.unionByName(kept)
        out = gated.where("decision != 'pass'" if i == rounds else "decision = 'refuse'").select("query_id", "route", F.lit(i).alias("retries"))
        refused = out if refused is None else refused.unionByName(out)
        again = gated.where("decision = 'retry'").select("query_id", F.col("original").alias("query"))
        if i < rounds:
            open_ = cut_lineage(models.reformulated(again, model).join(gated.select("query_id", "original", "route"), "query_id").select("query_id", "query", "original", "route"))
    grounded = cut_lineage(models.grounded(passed, model))
    about = passed.where("rank = 1").select("query_id", "route", "retries")
    checked = models.judged(grounded.where("answer is not null and not insufficient"), model).join(grounded.select("query_id", "cited"), "query_id")
    fails = F.col("verdict") == "fail"
    confidence = F.when(fails, "refused").when(F.col("verdict") == "partial", "low_confidence").otherwise("pass")
    checked = checked.select("query_id", F.when(fails, WITHHELD).otherwise(F.col("answer")).alias("answer"), F.col("cited").alias("citations"), confidence.alias("confidence"))
    done = about.join(checked, "query_id")
    rest = about.join(checked.select("query_id"), "query_id", "left_anti").unionByName(refused)
    none = rest.select("query_id", "route", "retries", F.lit(REFUSED).alias("answer"), F.array().cast("array<string>").alias("citations"), F.lit("refused").alias("confidence"))
    return done.select(*none.columns).unionByName(none).unionByName(direct)

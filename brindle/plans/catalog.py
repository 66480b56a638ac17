"""Registered queries of the retrieval engine and their SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import answers as A
from brindle.operators import chunking, retrieval as R
from brindle.operators import models, prompts
from brindle.operators.index import SCHEMAS, VERSION, Index
from brindle.plans import pipeline
from brindle.plans.physical import cut_lineage, shared_folder, spread, table
from brindle.sources import files

FETCH, TOP = 20, 5


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks"), "chunk_no")


def _index(spark: SparkSession, d: str) -> Index:
    """The stored index of the chunks in ``d``; each table is built by the first query that needs it, and anew when the chunks change. All edges are built for queries that return or count them, not for searches."""
    folder = f"{shared_folder(spark)}/index{VERSION}-{files.stamp(spark, f'{d}/chunks.parquet')}"
    return Index(spark, folder, chunks=_chunks(spark, d), from_texts=True)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_catalog").select("query_id", "query")


def q01_load_documents(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"[^ \t\n\r\f\x0B]"))
    kind = F.when(F.lower("filename").endswith(".pdf"), "pdf").otherwise("text")
    return docs.select("doc_id", "path", "filename", kind.alias("doc_type"), F.length("text").cast("bigint").alias("chars"))


def q02_chunk_documents(spark, d):
    out = chunking.chunk_documents(spread(table(spark, d, "documents").select("doc_id", "filename", "text"), "doc_id"))
    return out.select("doc_id", "chunk_index", "total_chunks", "chunk_id", F.md5("text").alias("text_md5"))


def q03_chunk_stats(spark, d):
    c = table(spark, d, "chunks").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return c.groupBy(F.lower("lang").alias("lang")).agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("text")).alias("chars"))


def q04_clean_text(spark, d):
    c = _chunks(spark, d).where("text is not null")
    return c.select("chunk_no", F.md5(F.lower(T.collapse(T.strip_glued_digits(F.col("text"))))).alias("clean_md5"), T.preview(F.col("text")).alias("preview"))


def q05_bm25_terms(spark, d):
    return _index(spark, d).table("terms").select("term", "df", F.round("idf", 6).alias("idf"))


def q06_bm25_search(spark, d):
    out = _index(spark, d).bm25(_asked(spark, d), FETCH)
    return out.select("query_id", "chunk_no", F.round("bm25_score_raw", 6).alias("bm25_score_raw"), F.round("bm25_score", 6).alias("bm25_score"), "bm25_rank")


def q07_vector_search(spark, d):
    v = spread(table(spark, d, "vector_store").select(F.col("vec_id").alias("chunk_no"), F.col("embeddings").alias("v")), "chunk_no")
    q = v.where("chunk_no % 50 = 0").select(F.col("chunk_no").alias("query_id"), "v")
    return R.knn(v, q, 10, 384).select("query_id", F.col("chunk_no").alias("vec_id"), F.round("score", 6).alias("vector_score"), "rank")


def q08_vector_knn_text(spark, d):
    out = _index(spark, d).vector(_asked(spark, d), FETCH)
    return out.select("query_id", "chunk_no", F.round("vector_score", 6).alias("vector_score"), "vector_rank")


def q09_graph_nodes(spark, d):
    return _index(spark, d).table("nodes")


def q10_graph_contains_edges(spark, d):
    return _index(spark, d).table("edges").select("chunk_no", "sid", "count")


def q11_graph_next_edges(spark, d):
    return _index(spark, d).table("next")


def q12_graph_stats(spark, d):
    index = _index(spark, d)
    kinds = index.table("nodes").agg(F.count(F.when(F.col("sid").startswith("ent_"), 1)).alias("entities"), F.count(F.when(F.col("sid").startswith("np_"), 1)).alias("concepts"))
    for name, column in (("edges", "contains_edges"), ("chunks", "chunks"), ("next", "next_edges")):
        kinds = kinds.crossJoin(index.table(name).agg(F.count("*").alias(column)))  # one row each
    return kinds


def q13_graph_search(spark, d):
    return _index(spark, d).graph(_asked(spark, d), FETCH)


def q14_subphrases(spark, d):
    return _asked(spark, d).select("query_id", F.explode(T.subphrases(F.lower(F.col("query")))).alias("phrase"))


def _hits(spark, d) -> DataFrame:
    return table(spark, d, "fused_hits").select("run_id", "query_id", "chunk_id", "vector_rank", "bm25_rank", "graph_rank", "vector_score", "bm25_score", "graph_score", "hit_at", "arrived_at")


def q15_rrf_recompute(spark, d):
    h = _hits(spark, d)
    rrf = sum((F.coalesce(F.lit(w) / (R.RRF_K + F.col(f"{n}_rank")), F.lit(0.0)) for n, w in R.WEIGHTS.items()), F.lit(0.0))
    found = F.array_join(F.filter(F.array(*[F.when(F.col(f"{n}_rank").isNotNull(), n) for n in R.WEIGHTS]), lambda x: x.isNotNull()), ",")
    return h.distinct().groupBy("run_id", "chunk_id").agg(F.round(F.max(rrf), 6).alias("rrf_score"), F.max(found).alias("found_in"), F.count("*").alias("n_rows"))


def q16_hybrid_retrieve(spark, d):
    return _index(spark, d).hybrid(_asked(spark, d), TOP, FETCH)


def _graph_only(spark, d):
    """Hits of other legs would weigh nothing and be dropped, so those aren't asked."""
    return R.fuse(None, None, _index(spark, d).graph(_asked(spark, d), FETCH), k=TOP, weights={"vector": 0.0, "bm25": 0.0, "graph": 1.0}).where("graph_score > 0")


def _vector_bm25(spark, d):
    """A graph hit would weigh nothing and come after all others, so the leg isn't asked: a query has vector hits enough, or no word at all."""
    index, q = _index(spark, d), _asked(spark, d)
    return R.fuse(index.vector(q, FETCH), index.bm25(q, FETCH), None, k=TOP, weights={"vector": 0.5, "bm25": 0.5, "graph": 0.0})


def q17_graph_only(spark, d):
    return _graph_only(spark, d).select("query_id", "chunk_no", "rank", "rrf_score", "graph_score")


def q18_vector_bm25(spark, d):
    return _vector_bm25(spark, d).select("query_id", "chunk_no", "rank", "rrf_score")


def q19_compare_overlap(spark, d):
    out = R.agreement(_vector_bm25(spark, d), _graph_only(spark, d))
    return out.withColumn("band", F.when(F.col("rate") >= 60, "high").when(F.col("rate") >= 30, "moderate").otherwise("low"))


def q20_vector_query_override(spark, d):
    """The vector leg is asked the text of the query's best keyword hit instead of the query."""
    index, q = _index(spark, d), _asked(spark, d)
    best = index.bm25(q, FETCH).where("bm25_rank = 1").select("query_id", "chunk_no")
    instead = R.few(best).join(index.table("chunks").select("chunk_no", "text"), "chunk_no").select("query_id", F.col("text").alias("query"))
    return index.hybrid(q, TOP, FETCH, vector_queries=instead).select("query_id", "chunk_no", "rank", "rrf_score", "found_in")


def q21_route_normalise(spark, d):
    r = table(spark, d, "pipeline_runs").select("run_id", "arrived_at", A.route_of(F.col("route")).alias("route"), A.route_of(F.col("route"), strict=True).alias("route_strict"))
    return r.groupBy("route", "route_strict").agg(F.count("*").alias("n"))


def q22_decompose_parse(spark, d):
    raw = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit('```json\n["'), F.replace("query", F.lit('"'), F.lit("'")), F.lit('", "second"]\n```'))).when(F.col("query_id") % 3 == 1, F.lit('{"not": "a list"}')).otherwise(F.lit("no json"))
    return _asked(spark, d).select("query_id", F.posexplode(A.sub_questions(raw, F.col("query"))).alias("sub", "question"))


def _halves(spark, d):
    """Each query (twice its id) and its first half (one more) as two questions."""
    q = _asked(spark, d)
    w = T.words(F.col("query"))
    half = F.array_join(F.slice(w, 1, F.ceil(F.size(w) / 2).cast("int")), " ")
    return q.select((F.col("query_id") * 2).alias("query_id"), "query").unionByName(q.select((F.col("query_id") * 2 + 1).alias("query_id"), half.alias("query")))


def _merged(hits, score):
    hits = hits.select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("sub"), "rank", "chunk_no", F.col(score).alias("score"))
    return R.distinct_hits(hits).select("query_id", "chunk_no", F.round("score", 6).alias("score"), "rank")


def q23_multi_retrieve(spark, d):
    """Each query and its first half as two questions, merged; keyword leg."""
    return _merged(_index(spark, d).bm25(_halves(spark, d), TOP).withColumnRenamed("bm25_rank", "rank"), "bm25_score_raw")


def _reranked(index, q, hits, place, k=TOP):
    """Hits (query_id, chunk_no, ``place``) with their texts, ordered by the reranker's score, then as they came."""
    s = R.few(hits.select("query_id", "chunk_no", F.col(place).alias("place"))).join(index.table("chunks").select("chunk_no", "chunk_id", "text"), "chunk_no").join(R.few(q), "query_id")
    s = s.withColumn("rerank_score", index.providers.reranker.score(F.col("query"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "place")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _keyword_reranked(spark, d):
    index, q = _index(spark, d), _asked(spark, d)
    return _reranked(index, q, index.bm25(q, FETCH), "bm25_rank")


def _hybrid_reranked(spark, d):
    """The fused hits of the three legs, as in q16, reranked."""
    index, q = _index(spark, d), _asked(spark, d)
    return _reranked(index, q, index.hybrid(q, TOP, FETCH), "rank")


def _gated(q, reranked):
    best = reranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("rerank_score"))).alias("s"), F.count("*").alias("n"))
    return q.join(best, "query_id", "left").withColumn("decision", A.gate(F.col("s"), F.col("n")))


def _loop_of(spark, d, answered, rounds=2):
    """Queries the gate sends back are asked again, without the last words of the original query: one the first time, two the second. Each round has only what is still open."""
    open_ = _asked(spark, d).withColumn("original", F.col("query"))
    done = None
    for i in range(rounds + 1):
        best = cut_lineage(_gated(open_, answered(open_.select("query_id", "query"))))  # else each round would run the earlier ones again
        ended = best if i == rounds else best.where("decision != 'retry'")
        ended = ended.select("query_id", F.when(F.col("decision") == "retry", "refuse").otherwise(F.col("decision")).alias("decision"), F.lit(i).alias("retries"))
        done = ended if done is None else done.unionByName(ended)
        w = T.words(F.col("original"))
        shorter = F.array_join(F.slice(w, 1, F.greatest(F.size(w) - (i + 1), F.lit(1))), " ")
        open_ = best.where("decision = 'retry'").select("query_id", shorter.alias("query"), "original")
    return done


def _context(reranked):
    return A.context(reranked.select("query_id", "rank", "chunk_id", "text")).select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


def q24_rerank(spark, d):
    return _keyword_reranked(spark, d).select("query_id", "chunk_no", "rerank_score", "rank")


def q25_confidence_gate(spark, d):
    return _gated(_asked(spark, d), _keyword_reranked(spark, d)).select("query_id", "decision")


def q26_corrective_loop(spark, d):
    """The loop on the best keyword hit."""
    index = _index(spark, d)
    return _loop_of(spark, d, lambda q: _reranked(index, q, index.bm25(q, TOP).where("bm25_rank = 1"), "bm25_rank"))


def q27_build_context(spark, d):
    return _context(_keyword_reranked(spark, d))


def q28_extract_citations(spark, d):
    runs = table(spark, d, "pipeline_runs").select("run_id", "answer", "citations", "arrived_at").where("answer is not null")
    ids = F.transform("citations", lambda c, i: F.struct(T.short_id(c, i).alias("short"), c.alias("chunk_id")))
    marks = runs.select("run_id", "answer", ids.alias("ids"), F.posexplode(A.cited(F.col("answer"))).alias("place", "short"))
    known = F.filter("ids", lambda x: x.short == F.col("short"))
    return marks.where(F.size(known) > 0).select("run_id", "place", "short", F.element_at(known, -1).chunk_id.alias("chunk_id")).distinct()


def q29_critic_apply(spark, d):
    runs = table(spark, d, "pipeline_runs").select("run_id", "answer").where("answer is not null").distinct()
    first = F.regexp_extract("answer", r"^([^\[]*\[C\d+\]\.?)", 1)
    raw = F.when(F.col("run_id") % 3 == 0, F.to_json(F.struct(F.lit("partial").alias("verdict"), F.array(first).alias("unsupported_sentences")))).when(F.col("run_id") % 3 == 1, F.lit('{"verdict": "pass"}')).otherwise(F.lit("garbage"))
    c = A.critic(raw)
    out = runs.withColumn("c", c)
    partial = (F.col("c.verdict") == "partial") & (F.size("c.unsupported_sentences") > 0)
    return out.select("run_id", F.col("c.verdict").alias("verdict"), F.when(partial, A.drop_sentences(F.col("answer"), F.col("c.unsupported_sentences"))).otherwise(F.col("answer")).alias("final_answer"))


def q30_latest_hits(spark, d):
    """Hits without exact repeats, the latest arrival of each (run, chunk), with how late it was."""
    h = _hits(spark, d).distinct()
    w = Window.partitionBy("run_id", "chunk_id").orderBy(F.desc("arrived_at"), F.desc("hit_at"), F.desc_nulls_last("vector_rank"), F.desc_nulls_last("bm25_rank"), F.desc_nulls_last("graph_rank"))
    h = h.withColumn("k", F.row_number().over(w)).where("k = 1")
    late = F.expr("timestampdiff(SECOND, hit_at, arrived_at)") > 3600
    return h.select("run_id", "chunk_id", "arrived_at", late.alias("late"))


def q31_hits_per_chunk(spark, d):
    """Hits by chunk, and what share of them names a chunk that the index no longer holds."""
    ids = table(spark, d, "chunks").select("chunk_id").distinct().withColumn("known", F.lit(1))
    h = _hits(spark, d).groupBy("chunk_id").agg(F.count("*").alias("hits"), F.countDistinct("query_id").alias("queries"))
    return h.join(ids, "chunk_id", "left").select("chunk_id", "hits", "queries", F.col("known").isNull().alias("orphan"))


def q32_hybrid_multi(spark, d):
    """q23 on the fused hits of the three legs."""
    return _merged(_index(spark, d).hybrid(_halves(spark, d), TOP, FETCH), "rrf_score")


def q33_hybrid_rerank(spark, d):
    return _hybrid_reranked(spark, d).select("query_id", "chunk_no", "rerank_score", "rank")


def q34_hybrid_gate(spark, d):
    return _gated(_asked(spark, d), _hybrid_reranked(spark, d)).select("query_id", "decision")


def q35_hybrid_loop(spark, d):
    """q26 as surveyed: each round retrieves from all three legs and reranks before the gate."""
    index = _index(spark, d)
    return _loop_of(spark, d, lambda q: _reranked(index, q, index.hybrid(q, TOP, FETCH), "rank"))


def q36_hybrid_context(spark, d):
    return _context(_hybrid_reranked(spark, d))


def q37_retrieve_payload(spark, d):
    """Results as a caller gets them: with text, source and place."""
    out = _index(spark, d).retrieve(_asked(spark, d), TOP, FETCH)
    keep = out.select("query_id", "rank", "chunk_id", "source", "filename", "doc_type", "chunk_index", "total_chunks", "rrf_score", "vector_score", "bm25_score", "graph_score", "text", "found_in")
    return keep.select(*[c for c in keep.columns if c not in ("text", "found_in")], F.md5("text").alias("text_md5"), F.array_join("found_in", "+").alias("found_in"))


def q38_index_tables(spark, d):
    """What the stored index holds."""
    index, out = _index(spark, d), None
    for name in SCHEMAS:
        one = index.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), (F.count("*") == 0).alias("is_empty"))
        out = one if out is None else out.unionByName(one)
    return out


def q39_compare_flags(spark, d):
    """Both result lists, each hit with whether the other list has it too."""
    v, g = (cut_lineage(x.select("query_id", "chunk_no", "rank")) for x in (_vector_bm25(spark, d), _graph_only(spark, d)))  # each is read twice, a few rows a query
    out = None
    for name, own, other in (("vector_bm25", v, g), ("graph", g, v)):
        seen = other.select("query_id", "chunk_no", F.lit(True).alias("seen"))
        one = own.join(seen, ["query_id", "chunk_no"], "left").select(F.lit(name).alias("mode"), "query_id", "chunk_no", "rank", F.coalesce("seen", F.lit(False)).alias("in_other"))
        out = one if out is None else out.unionByName(one)
    return out


def q40_file_order(spark, d):
    """Documents in the order of their paths, and those of one path by id."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("path", F.lit("")).alias("path"))
    place = F.struct("path", "doc_id")
    return files.in_order(docs.withColumn("place", place), "place").select("doc_id", "ordinal")


def q41_insufficient_context(spark, d):
    """Answers that say the context doesn't do, and so are refused; null answers say nothing."""
    runs = table(spark, d, "pipeline_runs").select("run_id", "answer", "confidence").distinct()
    return runs.groupBy(A.insufficient(F.col("answer")).alias("insufficient")).agg(F.count("*").alias("n"))


def q42_prompts(spark, d):
    return _asked(spark, d).select("query_id", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), prompts.fill(text, query=F.col("query"), context=F.lit("(context)"), answer=F.lit("(answer)")).alias("prompt")) for name, text in sorted(prompts.TEMPLATES.items())])).alias("x")).select("query_id", "x.name", F.md5("x.prompt").alias("prompt_md5"))


def q43_results(spark, d):
    """The latest row of each run as its result, with defaults."""
    runs = table(spark, d, "pipeline_runs")
    w = Window.partitionBy("run_id").orderBy(F.desc("arrived_at"), F.desc_nulls_last("answer"), F.desc_nulls_last("confidence"), F.desc_nulls_last("route"))
    return A.result(runs.withColumn("k", F.row_number().over(w)).where("k = 1"))


def q44_hyde(spark, d):
    """The vector leg is asked a model's passage instead of the query (here the stand-in's)."""
    index, q = _index(spark, d), _asked(spark, d)
    passages = models.hypothetical(q, models.echo)
    return index.hybrid(q, TOP, FETCH, vector_queries=passages).select("query_id", "chunk_no", "rank", "rrf_score", "found_in")


def q45_grounded_answers(spark, d):
    """Context, prompt, the stand-in's reply, and which chunks it cites."""
    answers = models.grounded(_keyword_reranked(spark, d).select("query_id", "query", "rank", "chunk_id", "text"), models.first_source)
    return answers.select("query_id", F.md5("answer").alias("answer_md5"), F.array_join("cited", ",").alias("cited"), "insufficient")


def q46_answers(spark, d):
    """The whole way from questions to checked answers, with the stand-in for the model. No SQL: see its test."""
    out = pipeline.answer_queries(_index(spark, d), _asked(spark, d), models.stand_in, TOP, FETCH)
    return out.select("query_id", "route", "retries", F.md5("answer").alias("answer_md5"), F.array_join("citations", ",").alias("citations"), "confidence")


QUERIES = {n: f for n, f in sorted(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}

# -- SQL -----------------------------------------------------------------------------------------------

_WS = r"[ \t\n\r\f\x0B]+"
_TOK = "list_filter(regexp_split_to_array(lower({0}), '" + _WS + "'), lambda x: x <> '')"
_WORDS = "list_filter(regexp_split_to_array({0}, '" + _WS + "'), lambda x: x <> '')"
_WITH = {
    "asked": "asked AS (SELECT query_id, query FROM query_catalog)",
    "posts": "posts AS (SELECT term, chunk_no, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_no, len(t) AS dl, unnest(t) AS term FROM (SELECT chunk_no, " + _TOK.format("text") + " AS t FROM chunks WHERE text IS NOT NULL)) GROUP BY ALL)",
    "stats": "stats AS (SELECT count(*) AS n, avg(len(" + _TOK.format("text") + ")) AS avgdl FROM chunks WHERE text IS NOT NULL)",
    "raw": "raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM posts, stats GROUP BY term)",
    "terms": "terms AS (SELECT term, df, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM raw) ELSE idf0 END AS idf FROM raw)",
}


def _bm25(asked: str = "asked", name: str = "bm25", k: int = FETCH) -> str:
    return f"""{name}_m AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM {asked}) GROUP BY ALL),
    {name}_s AS (SELECT query_id, chunk_no, sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM posts JOIN {name}_m USING (term) JOIN terms USING (term), stats GROUP BY ALL HAVING round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) > 0),
    {name} AS (SELECT query_id, chunk_no, score AS bm25_score_raw, score / max(score) OVER (PARTITION BY query_id) AS bm25_score, bm25_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_no)::INT AS bm25_rank FROM {name}_s) WHERE bm25_rank <= {k})"""


def _hashed(name: str, key: str, rel: str, text: str) -> str:
    return f"""{name}_b AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM (SELECT {key}, unnest({_TOK.format(text)}) AS w FROM {rel} WHERE {text} IS NOT NULL) GROUP BY ALL),
    {name} AS (SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS x FROM {name}_b)"""


_CV = _hashed("cv", "chunk_no", "chunks", "text")


def _vector(asked: str = "asked", p: str = "") -> str:
    return _hashed(f"{p}qv", "query_id", asked, "query") + f""",
    {p}vs AS (SELECT query_id, chunk_no, coalesce(sum(cv.x * q.x), 0) AS score FROM cv JOIN {p}qv q USING (b) GROUP BY ALL),
    {p}vector AS (SELECT query_id, chunk_no, score AS vector_score, vector_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_no)::INT AS vector_rank FROM {p}vs) WHERE vector_rank <= {FETCH})"""


_GRAM = "list_concat(list_transform(range(1, greatest(len(t) - 0, 1)), lambda i: array_to_string(list_slice(t, i, i + 1), ' ')), list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(list_slice(t, i, i + 2), ' ')))"


def _signals(name: str, key: str, rel: str, text: str, clean: bool) -> str:
    body = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_])\\d+([A-Za-z])', '\\1\\2', 'g')" if clean else text
    return f"""{name}_t AS (SELECT {key}, {body} AS x, {_TOK.format(body)} AS t FROM {rel} WHERE {text} IS NOT NULL),
    {name} AS (SELECT {key}, 'np_' || g AS sid, NULL::VARCHAR AS label FROM (SELECT {key}, unnest({_GRAM}) AS g FROM {name}_t)
        UNION ALL SELECT DISTINCT {key}, 'ent_' || lower(e), 'CAP' FROM (SELECT {key}, unnest(regexp_extract_all(x, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1)) AS e FROM {name}_t))"""


_CS = _signals("cs", "chunk_no", "chunks", "text", True)


def _graph(asked: str = "asked", p: str = "") -> str:
    return _signals(f"{p}qs", "query_id", asked, "query", False) + f""",
    {p}ge AS (SELECT DISTINCT chunk_no, sid FROM cs WHERE sid IN (SELECT sid FROM {p}qs)),
    {p}gw AS (SELECT sid, 1 / ln(1.0::DOUBLE + count(*)) AS idf FROM {p}ge GROUP BY sid),
    {p}gq AS (SELECT DISTINCT query_id, sid FROM {p}qs),
    {p}gt AS (SELECT query_id, sum(idf) AS total FROM {p}gq JOIN {p}gw USING (sid) GROUP BY ALL),
    {p}gm AS (SELECT query_id, chunk_no, round(sum(idf) / any_value(total), 6) AS graph_score FROM {p}ge JOIN {p}gw USING (sid) JOIN {p}gq USING (sid) JOIN {p}gt USING (query_id) GROUP BY ALL),
    {p}graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, chunk_no)::INT AS graph_rank FROM {p}gm) WHERE graph_rank <= {FETCH})"""


def _fuse(name: str, v: float, b: float, g: float, k: int = TOP, p: str = "") -> str:
    return f"""{name} AS (SELECT query_id, chunk_no, rank, round(rrf, 6) AS rrf_score, round(coalesce(vector_score, 0), 6) AS vector_score, round(coalesce(bm25_score, 0), 6) AS bm25_score,
        round(coalesce(graph_score, 0), 6) AS graph_score, vector_rank, bm25_rank, graph_rank,
        array_to_string(list_filter([CASE WHEN vector_rank IS NOT NULL THEN 'vector' END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN graph_rank IS NOT NULL THEN 'graph' END], lambda x: x IS NOT NULL), ',') AS found_in
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, CASE WHEN vector_rank IS NOT NULL THEN 0 WHEN bm25_rank IS NOT NULL THEN 1 ELSE 2 END, coalesce(vector_rank, bm25_rank, graph_rank), chunk_no)::INT AS rank
        FROM (SELECT *, 0.0::DOUBLE + coalesce({v}::DOUBLE / (60 + vector_rank), 0) + coalesce({b}::DOUBLE / (60 + bm25_rank), 0) + coalesce({g}::DOUBLE / (60 + graph_rank), 0) AS rrf
          FROM {p}vector FULL JOIN {p}bm25 USING (query_id, chunk_no) FULL JOIN {p}graph USING (query_id, chunk_no))) WHERE rank <= {k})"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(_WITH.get(p, p) for p in parts) + "\n"


_BM = ("asked", "posts", "stats", "raw", "terms")
_LEGS = (*_BM, _bm25(), _CV, _vector(), _CS, _graph())
_OVER = "round(20.0::DOUBLE * len(list_filter(list_distinct(" + _TOK.format("query") + "), lambda w: list_contains(" + _TOK.format("text") + ", w))) / nullif(len(list_distinct(" + _TOK.format("query") + ")), 0) - 10.0, 6)"
_CLEAN = r"regexp_replace(text, '(^|[^\p{L}\p{N}_])\d+([A-Za-z])', '\1\2', 'g')"
_RERANK = f"""rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, bm25_rank)::INT AS rank
    FROM (SELECT query_id, chunk_no, chunk_id, text, bm25_rank, {_OVER} AS rerank_score FROM bm25 JOIN chunks USING (chunk_no) JOIN asked USING (query_id))) WHERE rank <= {TOP})"""
_SHORT = "CASE WHEN regexp_extract({0}, 'chunk_(\\d+)$', 1) <> '' THEN 'C' || regexp_extract({0}, 'chunk_(\\d+)$', 1)::BIGINT ELSE 'C' || ({1} + 1) END"
_GATE = "CASE WHEN coalesce({n}, 0) = 0 THEN 'refuse' WHEN coalesce({s}, 0) >= 0 THEN 'pass' WHEN coalesce({s}, 0) >= -3 THEN 'retry' ELSE 'refuse' END"
_ROUTE = "regexp_replace(lower(trim(route)), '[.,!? \\n]+$', '')"
_NAMED = "lower(regexp_extract(route, '\"route\"\\s*:\\s*\"([A-Za-z]+)\"', 1))"


def _loop() -> str:
    out, parts = list(_BM), []
    for i in range(3):
        rel = "asked" if i == 0 else f"open{i}"
        out.append(_bm25(rel, f"b{i}", TOP))
        out.append(f"g{i} AS (SELECT query_id, query, {_GATE.format(n='CASE WHEN chunk_no IS NOT NULL THEN 1 END', s='s')} AS decision FROM (SELECT {rel}.query_id, query, chunk_no, {_OVER} AS s FROM {rel} LEFT JOIN (SELECT query_id, chunk_no FROM b{i} WHERE bm25_rank = 1) USING (query_id) LEFT JOIN chunks USING (chunk_no)))")
        out.append(f"open{i + 1} AS (SELECT query_id, array_to_string(list_slice({_WORDS.format('query')}, 1, greatest(len({_WORDS.format('query')}) - 1, 1)), ' ') AS query FROM g{i} WHERE decision = 'retry')")
        parts.append(f"SELECT query_id, CASE WHEN decision = 'retry' THEN 'refuse' ELSE decision END AS decision, {i} AS retries FROM g{i}" + ("" if i == 2 else " WHERE decision <> 'retry'"))
    return _with(*out) + " UNION ALL ".join(parts)


_TWO = f"two AS (SELECT query_id * 2 AS query_id, query FROM asked UNION ALL SELECT query_id * 2 + 1, array_to_string(list_slice({_WORDS.format('query')}, 1, ceil(len({_WORDS.format('query')}) / 2.0)::INT), ' ') FROM asked)"
_MERGE = """SELECT query_id, chunk_no, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_no)::INT AS rank FROM (SELECT query_id // 2 AS query_id, chunk_no, arg_max({raw}, (query_id % 2) * 1000 + {place}) AS score,
    min((query_id % 2) * 1000 + {place}) AS place FROM {hits} GROUP BY 1, 2)"""
_FUSED = _fuse("fused", 0.4, 0.3, 0.3)
_HYBRID = f"""rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, place)::INT AS rank
    FROM (SELECT query_id, chunk_no, chunk_id, text, fused.rank AS place, {_OVER} AS rerank_score FROM fused JOIN chunks USING (chunk_no) JOIN asked USING (query_id))) WHERE rank <= {TOP})"""
_GATED = f"SELECT query_id, {_GATE.format(n='n', s='s')} AS decision FROM asked LEFT JOIN (SELECT query_id, max(rerank_score) FILTER (rank = 1) AS s, count(*) AS n FROM rr GROUP BY query_id) USING (query_id)"
_LABELS = (f"l AS (SELECT *, {_SHORT.format('chunk_id', '(rank - 1)')} AS label FROM rr)", "m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id, label) > 1 THEN 'C#' || rank ELSE label END AS mark FROM l)")
_CONTEXT = "SELECT query_id, md5(string_agg('[' || mark || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5, length(string_agg('[' || mark || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank))::INT AS chars FROM m GROUP BY query_id"
_LISTS = (*_LEGS, _fuse("v", 0.5, 0.5, 0.0), _fuse("g0", 0.0, 0.0, 1.0), "g AS (SELECT * FROM g0 WHERE graph_score > 0)")


def _filled(name: str) -> str:
    """SQL for a template filled as in q42."""
    text = prompts.TEMPLATES[name].replace("'", "''")
    for hole, value in (("{query}", "' || query || '"), ("{context}", "(context)"), ("{answer}", "(answer)"), ("{{", "{"), ("}}", "}")):
        text = text.replace(hole, value)
    return f"SELECT query_id, '{name}' AS name, md5('{text}') AS prompt_md5 FROM query_catalog"


def _hybrid_loop() -> str:
    out, parts = [*_BM, _CV, _CS], []
    for i in range(3):
        rel, p = "asked" if i == 0 else f"open{i}", f"r{i}_"
        out += [_bm25(rel, f"{p}bm25"), _vector(rel, p), _graph(rel, p), _fuse(f"f{i}", 0.4, 0.3, 0.3, TOP, p)]
        out.append(f"g{i} AS (SELECT query_id, query, {_GATE.format(n='n', s='s')} AS decision FROM {rel} LEFT JOIN (SELECT query_id, max({_OVER}) AS s, count(*) AS n FROM f{i} JOIN chunks USING (chunk_no) JOIN {rel} USING (query_id) GROUP BY query_id) USING (query_id))")
        out.append(f"open{i + 1} AS (SELECT query_id, array_to_string(list_slice({_WORDS.format('query')}, 1, greatest(len({_WORDS.format('query')}) - 1, 1)), ' ') AS query FROM g{i} WHERE decision = 'retry')")
        parts.append(f"SELECT query_id, CASE WHEN decision = 'retry' THEN 'refuse' ELSE decision END AS decision, {i} AS retries FROM g{i}" + ("" if i == 2 else " WHERE decision <> 'retry'"))
    return _with(*out) + " UNION ALL ".join(parts)


SQL = {
    "q01_load_documents": r"SELECT doc_id, path, filename, CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' ELSE 'text' END AS doc_type, length(text) AS chars FROM documents WHERE regexp_matches(text, '[^ \t\n\r\f\x0B]')",
    "q02_chunk_documents": f"""WITH t AS (SELECT doc_id, filename, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, filename, k, array_to_string(list_slice(w, k * 200 + 1, k * 200 + 250), ' ') AS text FROM (SELECT *, unnest(range(0, CASE WHEN len(w) <= 250 THEN 1 ELSE 1 + ceil((len(w) - 250) / 200.0)::INT END)) AS k FROM t WHERE len(w) > 0)),
        n AS (SELECT doc_id, filename, text, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id)::INT AS total_chunks FROM p WHERE length(text) > 50)
        SELECT doc_id, chunk_index, total_chunks, coalesce(regexp_replace(filename, '[^a-zA-Z0-9_\\-]', '_', 'g'), 'doc_' || doc_id) || '_chunk_' || printf('%05d', chunk_index) AS chunk_id, md5(text) AS text_md5 FROM n""",
    "q03_chunk_stats": "SELECT lower(lang) AS lang, count(*) AS n_chunks, count(DISTINCT c.doc_id) AS n_docs, sum(length(c.text))::BIGINT AS chars FROM chunks c JOIN documents d USING (doc_id) GROUP BY 1",
    "q04_clean_text": f"""WITH c AS (SELECT chunk_no, array_to_string({_WORDS.format(_CLEAN)}, ' ') AS clean, array_to_string({_WORDS.format('text')}, ' ') AS flat FROM chunks WHERE text IS NOT NULL)
        SELECT chunk_no, md5(lower(clean)) AS clean_md5, CASE WHEN length(flat) > 70 THEN substr(flat, 1, 70) || '...' ELSE flat END AS preview FROM c""",
    "q05_bm25_terms": _with("posts", "stats", "raw", "terms") + "SELECT term, df, round(idf, 6) AS idf FROM terms",
    "q06_bm25_search": _with(*_BM, _bm25()) + "SELECT query_id, chunk_no, round(bm25_score_raw, 6) AS bm25_score_raw, round(bm25_score, 6) AS bm25_score, bm25_rank FROM bm25",
    "q07_vector_search": """WITH v AS (SELECT vec_id, embeddings::DOUBLE[384] AS v FROM (SELECT vec_id, embeddings FROM vector_store WHERE len(embeddings) = 384 AND len(list_filter(embeddings, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0)),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, array_cosine_similarity(q.v, v.v) AS s FROM v JOIN v q ON q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, vec_id, round(s, 6) AS vector_score, rank FROM r WHERE rank <= 10""",
    "q08_vector_knn_text": _with("asked", _CV, _vector()) + "SELECT query_id, chunk_no, round(vector_score, 6) AS vector_score, vector_rank FROM vector",
    "q09_graph_nodes": _with(_CS) + "SELECT sid, arg_min(label, chunk_no) AS label, count(DISTINCT chunk_no) AS degree FROM cs GROUP BY sid",
    "q10_graph_contains_edges": _with(_CS) + 'SELECT chunk_no, sid, count(*) AS "count" FROM cs GROUP BY ALL',
    "q11_graph_next_edges": "SELECT src, dst FROM (SELECT chunk_no AS src, lead(chunk_no) OVER (PARTITION BY source ORDER BY chunk_index, chunk_no) AS dst FROM chunks WHERE chunk_index IS NOT NULL) WHERE dst IS NOT NULL",
    "q12_graph_stats": _with(_CS, "e AS (SELECT DISTINCT chunk_no, sid FROM cs)")
    + """SELECT count(DISTINCT sid) FILTER (sid LIKE 'ent\\_%' ESCAPE '\\') AS entities, count(DISTINCT sid) FILTER (sid LIKE 'np\\_%' ESCAPE '\\') AS concepts, count(*) AS contains_edges, (SELECT count(*) FROM chunks) AS chunks,
        (SELECT count(*) FROM (SELECT lead(chunk_no) OVER (PARTITION BY source ORDER BY chunk_index, chunk_no) AS dst FROM chunks WHERE chunk_index IS NOT NULL) WHERE dst IS NOT NULL) AS next_edges FROM e""",
    "q13_graph_search": _with("asked", _CS, _graph()) + "SELECT query_id, chunk_no, graph_score, graph_rank FROM graph",
    "q14_subphrases": f"""WITH t AS (SELECT query_id, {_WORDS.format('lower(query)')} AS t FROM query_catalog)
        SELECT query_id, phrase FROM (SELECT query_id, len(t) AS n, unnest({_GRAM}) AS phrase FROM t) WHERE len(string_split(phrase, ' ')) < n""",
    "q15_rrf_recompute": """WITH h AS (SELECT DISTINCT run_id, query_id, chunk_id, vector_rank, bm25_rank, graph_rank, vector_score, bm25_score, graph_score, hit_at, arrived_at FROM fused_hits)
        SELECT run_id, chunk_id, round(max(0.0::DOUBLE + coalesce(0.4::DOUBLE / (60 + vector_rank), 0) + coalesce(0.3::DOUBLE / (60 + bm25_rank), 0) + coalesce(0.3::DOUBLE / (60 + graph_rank), 0)), 6) AS rrf_score,
        max(array_to_string(list_filter([CASE WHEN vector_rank IS NOT NULL THEN 'vector' END, CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN graph_rank IS NOT NULL THEN 'graph' END], lambda x: x IS NOT NULL), ',')) AS found_in, count(*) AS n_rows FROM h GROUP BY run_id, chunk_id""",
    "q16_hybrid_retrieve": _with(*_LEGS, _fuse("fused", 0.4, 0.3, 0.3)) + "SELECT * FROM fused",
    "q17_graph_only": _with(*_LEGS, _fuse("fused", 0.0, 0.0, 1.0)) + "SELECT query_id, chunk_no, rank, rrf_score, graph_score FROM fused WHERE graph_score > 0",
    "q18_vector_bm25": _with(*_LEGS, _fuse("fused", 0.5, 0.5, 0.0)) + "SELECT query_id, chunk_no, rank, rrf_score FROM fused",
    "q19_compare_overlap": _with(*_LEGS, _fuse("v", 0.5, 0.5, 0.0), _fuse("g0", 0.0, 0.0, 1.0), "g AS (SELECT * FROM g0 WHERE graph_score > 0)")
    + """SELECT *, CASE WHEN rate >= 60 THEN 'high' WHEN rate >= 30 THEN 'moderate' ELSE 'low' END AS band FROM (SELECT query_id, count(v.chunk_no) AS n_a, count(g.chunk_no) AS n_b,
        count(*) FILTER (v.chunk_no IS NOT NULL AND g.chunk_no IS NOT NULL) AS overlap, round(count(*) FILTER (v.chunk_no IS NOT NULL AND g.chunk_no IS NOT NULL) * 100.0::DOUBLE / greatest(count(v.chunk_no), count(g.chunk_no), 1), 6) AS rate
        FROM v FULL JOIN g USING (query_id, chunk_no) GROUP BY query_id)""",
    "q20_vector_query_override": _with(*_BM, _bm25(), "instead AS (SELECT query_id, text AS query FROM bm25 JOIN chunks USING (chunk_no) WHERE bm25_rank = 1)", _CV, _vector("instead"), _CS, _graph(), _fuse("fused", 0.4, 0.3, 0.3)) + "SELECT query_id, chunk_no, rank, rrf_score, found_in FROM fused",
    "q21_route_normalise": f"""SELECT route, route_strict, count(*) AS n FROM (SELECT CASE WHEN coalesce(nullif({_NAMED}, ''), {_ROUTE}) IN ('direct', 'simple', 'complex') THEN coalesce(nullif({_NAMED}, ''), {_ROUTE}) ELSE 'simple' END AS route,
        CASE WHEN {_ROUTE} IN ('direct', 'simple', 'complex') THEN {_ROUTE} ELSE 'simple' END AS route_strict FROM pipeline_runs) GROUP BY ALL""",
    "q22_decompose_parse": """SELECT query_id, 0 AS sub, CASE WHEN query_id % 3 = 0 THEN replace(query, '"', '''') ELSE query END AS question FROM query_catalog UNION ALL SELECT query_id, 1, 'second' FROM query_catalog WHERE query_id % 3 = 0""",
    "q23_multi_retrieve": _with(*_BM, _TWO, _bm25("two", "bm25", TOP)) + _MERGE.format(score="round(score, 6)", place="bm25_rank", raw="bm25_score_raw", hits="bm25"),
    "q24_rerank": _with(*_BM, _bm25(), _RERANK) + "SELECT query_id, chunk_no, rerank_score, rank FROM rr",
    "q25_confidence_gate": _with(*_BM, _bm25(), _RERANK) + f"SELECT query_id, {_GATE.format(n='n', s='s')} AS decision FROM asked LEFT JOIN (SELECT query_id, max(rerank_score) FILTER (rank = 1) AS s, count(*) AS n FROM rr GROUP BY query_id) USING (query_id)",
    "q26_corrective_loop": _loop(),
    "q27_build_context": _with(*_BM, _bm25(), _RERANK, f"l AS (SELECT *, {_SHORT.format('chunk_id', '(rank - 1)')} AS label FROM rr)", "m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id, label) > 1 THEN 'C#' || rank ELSE label END AS mark FROM l)")
    + "SELECT query_id, md5(string_agg('[' || mark || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5, length(string_agg('[' || mark || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank))::INT AS chars FROM m GROUP BY query_id",
    "q28_extract_citations": f"""WITH r AS (SELECT DISTINCT run_id, answer, citations FROM pipeline_runs WHERE answer IS NOT NULL),
        a AS (SELECT run_id, unnest(list_transform(regexp_extract_all(answer, '\\[C(\\d+)\\]', 1), lambda n: 'C' || n)) AS short, unnest(range(0, len(regexp_extract_all(answer, '\\[C(\\d+)\\]', 1)))) AS nth FROM r),
        f AS (SELECT run_id, short, (row_number() OVER (PARTITION BY run_id ORDER BY min(nth)) - 1)::INT AS place FROM a GROUP BY run_id, short),
        c AS (SELECT run_id, unnest(citations) AS chunk_id, unnest(range(0, len(citations))) AS i FROM r),
        k AS (SELECT run_id, {_SHORT.format('chunk_id', 'i')} AS short, chunk_id, i FROM c)
        SELECT run_id, place, short, arg_max(chunk_id, i) AS chunk_id FROM f JOIN k USING (run_id, short) GROUP BY ALL""",
    "q29_critic_apply": f"""WITH r AS (SELECT DISTINCT run_id, answer, regexp_extract(answer, '^([^\\[]*\\[C\\d+\\]\\.?)', 1) AS bad FROM pipeline_runs WHERE answer IS NOT NULL)
        SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'partial' ELSE 'pass' END AS verdict, CASE WHEN run_id % 3 = 0 THEN array_to_string({_WORDS.format("CASE WHEN bad = '' THEN answer ELSE replace(answer, bad, '') END")}, ' ') ELSE answer END AS final_answer FROM r""",
    "q30_latest_hits": """WITH h AS (SELECT DISTINCT run_id, chunk_id, vector_rank, bm25_rank, graph_rank, hit_at, arrived_at FROM fused_hits)
        SELECT run_id, chunk_id, arrived_at, epoch(arrived_at - hit_at) >= 3601 AS late FROM (SELECT *, row_number() OVER (PARTITION BY run_id, chunk_id ORDER BY arrived_at DESC, hit_at DESC, vector_rank DESC NULLS LAST, bm25_rank DESC NULLS LAST, graph_rank DESC NULLS LAST) AS k FROM h) WHERE k = 1""",
    "q31_hits_per_chunk": "SELECT chunk_id, count(*) AS hits, count(DISTINCT query_id) AS queries, chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) AS orphan FROM fused_hits GROUP BY chunk_id",
    "q32_hybrid_multi": _with(*_BM, _TWO, _bm25("two"), _CV, _vector("two"), _CS, _graph("two"), _FUSED) + _MERGE.format(score="round(score, 6)", place="rank", raw="rrf_score", hits="fused"),
    "q33_hybrid_rerank": _with(*_LEGS, _FUSED, _HYBRID) + "SELECT query_id, chunk_no, rerank_score, rank FROM rr",
    "q34_hybrid_gate": _with(*_LEGS, _FUSED, _HYBRID) + _GATED,
    "q35_hybrid_loop": _hybrid_loop(),
    "q36_hybrid_context": _with(*_LEGS, _FUSED, _HYBRID, *_LABELS) + _CONTEXT,
    "q37_retrieve_payload": _with(*_LEGS, _FUSED) + """SELECT query_id, rank, chunk_id, source, filename, doc_type, chunk_index, total_chunks, rrf_score, vector_score, bm25_score, graph_score, md5(text) AS text_md5, replace(found_in, ',', '+') AS found_in FROM fused JOIN chunks USING (chunk_no)""",
    "q38_index_tables": _with("posts", _CS, _CV) + "SELECT name, n_rows, n_rows = 0 AS is_empty FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, ({count}) AS n_rows" for name, count in (
        ("chunks", "SELECT count(*) FROM chunks"), ("postings", "SELECT count(*) FROM posts"), ("terms", "SELECT count(DISTINCT term) FROM posts"), ("corpus", "SELECT 1"), ("vectors", "SELECT count(DISTINCT chunk_no) FROM cv"),
        ("edges", "SELECT count(*) FROM (SELECT DISTINCT chunk_no, sid FROM cs)"), ("nodes", "SELECT count(DISTINCT sid) FROM cs"),
        ("next", "SELECT count(*) FROM (SELECT lead(chunk_no) OVER (PARTITION BY source ORDER BY chunk_index, chunk_no) AS dst FROM chunks WHERE chunk_index IS NOT NULL) WHERE dst IS NOT NULL"))) + ")",
    "q39_compare_flags": _with(*_LISTS) + """SELECT 'vector_bm25' AS mode, v.query_id, v.chunk_no, v.rank, EXISTS (SELECT 1 FROM g WHERE g.query_id = v.query_id AND g.chunk_no = v.chunk_no) AS in_other FROM v
        UNION ALL SELECT 'graph', g.query_id, g.chunk_no, g.rank, EXISTS (SELECT 1 FROM v WHERE g.query_id = v.query_id AND g.chunk_no = v.chunk_no) FROM g""",
    "q40_file_order": "SELECT doc_id, row_number() OVER (ORDER BY coalesce(path, ''), doc_id) - 1 AS ordinal FROM documents",
    "q41_insufficient_context": "SELECT coalesce(contains(answer, 'INSUFFICIENT_CONTEXT'), false) AS insufficient, count(*) AS n FROM (SELECT DISTINCT run_id, answer, confidence FROM pipeline_runs) GROUP BY 1",
    "q42_prompts": " UNION ALL ".join(map(_filled, sorted(prompts.TEMPLATES))),
    "q43_results": """SELECT run_id, coalesce(answer, '') AS answer, coalesce(array_to_string(citations, ','), '') AS citations, coalesce(route, '') AS route, coalesce(confidence, 'none') AS confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrived_at DESC, answer DESC NULLS LAST, confidence DESC NULLS LAST, route DESC NULLS LAST) AS k FROM pipeline_runs) WHERE k = 1""",
    "q44_hyde": _with(*_BM, _bm25(), "instead AS (SELECT query_id, 'This passage is about ' || query AS query FROM asked)", _CV, _vector("instead"), _CS, _graph(), _FUSED) + "SELECT query_id, chunk_no, rank, rrf_score, found_in FROM fused",
    "q45_grounded_answers": _with(*_BM, _bm25(), _RERANK, *_LABELS, "f AS (SELECT query_id, mark, chunk_id, string_split(string_split(text, chr(10))[1], ' ') AS w, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM m WHERE mark NOT LIKE 'C#%')")
    + """SELECT query_id, md5(coalesce(array_to_string(list_slice(w, 1, 10), ' ') || ' [' || mark || '].', 'INSUFFICIENT_CONTEXT')) AS answer_md5, coalesce(chunk_id, '') AS cited, mark IS NULL AS insufficient
        FROM (SELECT DISTINCT query_id FROM m) LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (query_id)""",
}

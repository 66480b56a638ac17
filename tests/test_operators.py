import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import answers as A
from brindle.operators import chunking, retrieval as R
from brindle.sources import files


def values(spark, expr, *rows, cols="t string"):
    return [r[0] for r in spark.createDataFrame(list(rows), cols).select(expr).collect()]


def test_glued_digits(spark):
    got = values(spark, T.strip_glued_digits(F.col("t")), ("13Combination Cooking",), ("12Grill",), ("Chapter 13",), ("100%",), ("3D",), ("x13b",))
    assert got == ["Combination Cooking", "Grill", "Chapter 13", "100%", "D", "x13b"]


def test_subphrases(spark):
    got = values(spark, T.subphrases(F.col("t")), ("combination cooking feature",), ("two words",), ("a b c d",))
    assert got == [["combination cooking", "cooking feature"], [], ["a b", "b c", "c d", "a b c", "b c d"]]


def test_windows(spark):
    rows = [(i, "f.md", " ".join(["tokenword"] * n)) for i, n in enumerate([0, 1, 250, 251, 450, 451, 1000])] + [(7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, filename string, text string")
    n = {r.doc_id: r.n for r in chunking.chunk_documents(docs, least_chars=0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 5}
    with pytest.raises(ValueError):
        chunking.chunk_documents(docs, 50, 50)


def test_chunk_filter_and_ids(spark):
    docs = spark.createDataFrame([(1, "contract.pdf", "x" * 50), (2, "contract.pdf", "x" * 51), (3, None, "y" * 60)], "doc_id long, filename string, text string")
    assert sorted(r.chunk_id for r in chunking.chunk_documents(docs).collect()) == ["contract_pdf_chunk_00000", "doc_3_chunk_00000"]


def corpus(spark):
    return spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat down"), (3, "a bird flew"), (4, "cat and dog"), (5, None), (6, "")][:4], "chunk_no long, text string")


@pytest.mark.parametrize("query, want", [("bird", [(3, 0.877679)]), ("bird flew", [(3, 1.755358)]), ("cat", []), ("", [])])
def test_bm25(spark, query, want):
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    assert [(r.chunk_no, round(r.bm25_score_raw, 6)) for r in R.bm25_search(corpus(spark), q).collect()] == want


def test_bm25_empty_corpus(spark):
    q = spark.createDataFrame([(1, "bird")], "query_id long, query string")
    assert R.bm25_search(corpus(spark).where("false"), q).count() == 0


def leg(spark, name, rows):
    return spark.createDataFrame(rows or [(0, 0, 0.0, 0)], f"query_id long, chunk_no long, {name}_score double, {name}_rank int").where("query_id > 0")


def test_fusion(spark):
    out = R.fuse(leg(spark, "vector", [(1, 10, 0.9, 1), (1, 11, 0.8, 2)]), leg(spark, "bm25", [(1, 11, 1.0, 1), (1, 12, 0.5, 2)]), leg(spark, "graph", [(1, 13, 0.7, 1)]), k=9)
    got = {r.chunk_no: (r.rrf_score, r.found_in) for r in out.collect()}
    assert got == {10: (0.006557, "vector"), 11: (0.01137, "vector,bm25"), 12: (0.004839, "bm25"), 13: (0.004918, "graph")}


def test_fusion_ties_keep_list_order(spark):
    out = R.fuse(leg(spark, "vector", [(1, 2, 0.5, 1)]), leg(spark, "bm25", [(1, 1, 0.5, 1)]), leg(spark, "graph", []), weights={"vector": 0.5, "bm25": 0.5, "graph": 0.0})
    assert [r.chunk_no for r in out.orderBy("rank").collect()] == [2, 1]


def test_graph_weights(spark):
    chunks = spark.createDataFrame([(1, "red fox runs"), (2, "red fox"), (3, "lazy dog")], "chunk_no long, text string")
    q = spark.createDataFrame([(1, "red fox runs")], "query_id long, query string")
    got = {r.chunk_no: r.graph_score for r in R.graph_search(chunks, q).collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1 and 3 not in got


def test_knn_ignores_unusable(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [3.0, 0.1])], "chunk_no long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>")
    assert [r.chunk_no for r in R.knn(v, q, 2, 2).orderBy("rank").collect()] == [1, 7]


def test_routes(spark):
    rows = [("Simple.",), ("complex!",), ('{"route": "direct"}',), (None,), ("nonsense",)]
    assert values(spark, A.route_of(F.col("t")), *rows) == ["simple", "complex", "direct", "simple", "simple"]
    assert values(spark, A.route_of(F.col("t"), strict=True), *rows)[2] == "simple"


def test_sub_questions(spark):
    rows = [('["a", "b"]',), ('```json\n["a"]\n```',), ('{"a": 1}',), ("garbage",)]
    assert values(spark, A.sub_questions(F.col("t"), F.lit("q")), *rows) == [["a", "b"], ["a"], ["q"], ["q"]]


def test_critic_and_citations(spark):
    assert values(spark, A.drop_sentences(F.col("t"), F.array(F.lit("Bad one."))), ("Good. Bad one. End",)) == ["Good. End"]
    assert values(spark, A.critic(F.col("t")).verdict, ('{"verdict": "fail"}',), ("garbage",)) == ["fail", "pass"]
    assert values(spark, A.cited(F.col("t")), ("x [C137] y [NEW] [C9] [C137]",)) == [["C137", "C9"]]
    assert values(spark, T.short_id(F.col("t"), F.lit(0)), ("a_chunk_00137",), ("other",)) == ["C137", "C1"]


def test_context_labels_clash(spark):
    h = spark.createDataFrame([(1, 1, "a_chunk_00002", "x"), (1, 2, "b_chunk_00002", "y")], "query_id long, rank int, chunk_id string, text string")
    assert A.context(h).first().context == "[C#1]\nx\n\n---\n\n[C#2]\ny"


@pytest.mark.parametrize("score, n, want", [(None, 0, "refuse"), (0.0, 1, "pass"), (-0.01, 1, "retry"), (-3.0, 1, "retry"), (-3.01, 1, "refuse"), (None, 1, "pass")])
def test_gate(spark, score, n, want):
    assert spark.createDataFrame([(score, n)], "s double, n int").select(A.gate(F.col("s"), F.col("n"))).first()[0] == want


def test_agreement(spark):
    hits = lambda ids: spark.createDataFrame([(1, i) for i in ids], "query_id long, chunk_no long")
    r = R.agreement(hits([1, 2, 3]), hits([2, 3, 4, 5])).first()
    assert (r.overlap, r.rate) == (2, 50.0)


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.MD").write_text("hello\r\nworld")
    (tmp_path / "sub" / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "blank.txt").write_text("  \n")
    (tmp_path / "skip.csv").write_text("x")
    good, bad = files.read_folder(spark, str(tmp_path))
    assert [(r.filename, r.text) for r in good.collect()] == [("a.MD", "hello\nworld")]
    assert len(bad.collect()) == 1


def test_index_tables(spark, tmp_path):
    t = {"terms": spark.createDataFrame([("a", 1)], "term string, df long")}
    assert files.write_index(t, str(tmp_path)) and not files.write_index(t, str(tmp_path))
    assert files.read_index(spark, str(tmp_path), "terms").count() == 1
    assert files.read_index(spark, str(tmp_path), "graph", "sid string").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_index(spark, str(tmp_path), "graph")


def test_stream(spark, tmp_path):
    from brindle.streaming import ingest

    docs = spark.createDataFrame([(1, "f.md", "word " * 300)], "doc_id long, filename string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    s = ingest.stream_chunks(ingest.document_stream(spark, str(tmp_path / "in"), docs.schema))
    ingest.append_chunks(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    docs.unionByName(docs.withColumn("doc_id", F.lit(2).cast("long"))).write.mode("append").parquet(str(tmp_path / "in"))  # a known document comes again
    s = ingest.stream_chunks(ingest.document_stream(spark, str(tmp_path / "in"), docs.schema))
    ingest.append_chunks(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 4 == out.select("doc_id", "chunk_index").distinct().count()


def test_late_hits_are_counted_by_their_day(spark, tmp_path):
    from brindle.streaming import ingest

    rows = [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 23:00:00"), (1, "2024-01-02 01:00:00")]
    hits = spark.createDataFrame(rows, "run_id long, hit_at string").withColumn("hit_at", F.col("hit_at").cast("timestamp"))
    hits.write.parquet(str(tmp_path / "hits"))
    stream = ingest.hits_per_window(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits")))
    stream.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r.day)[:10], r.hits, r.runs) for r in spark.table("days").collect()) == [("2024-01-01", 2, 2), ("2024-01-02", 1, 1)]


def test_entry_without_llm():
    import __spark_entry__ as e

    assert {n for n in e.queries() if n.startswith("q")} == {n for n in e.oracle_sql() if n.startswith("q")} | {"q46_answers"}


def test_hybrid_loop_reranks_before_the_gate(spark, tmp_path):
    from brindle.plans import catalog

    texts = ["alpha alpha alpha alpha", "alpha beta gamma and more words that only make this text longer"] + [f"filler{i} text" for i in range(8)]
    rows = [(i, f"f_chunk_{i:05d}", t, "f", i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "chunk_no long, chunk_id string, text string, source string, chunk_index int").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "alpha beta gamma"), (2, "nowhere found")], "query_id long, query string").write.parquet(f"{tmp_path}/query_catalog.parquet")
    got = {r.query_id: (r.decision, r.retries) for r in catalog.QUERIES["q35_hybrid_loop"](spark, str(tmp_path)).collect()}
    assert got == {1: ("pass", 0), 2: ("refuse", 0)}
    assert {r.chunk_no for r in catalog.QUERIES["q33_hybrid_rerank"](spark, str(tmp_path)).where("query_id = 1 and rank = 1").collect()} == {1}


# -- stored indexes, providers, models -------------------------------------------------------------------


def test_ingest_and_retrieve(spark, tmp_path):
    from brindle.__main__ import main
    from brindle.operators.index import Index

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.md").write_text("The red fox runs over the frozen lake. " * 3)
    (tmp_path / "in" / "a.txt").write_text("A lazy dog sleeps beside the warm oven. " * 3)
    assert main(["ingest", str(tmp_path / "in"), str(tmp_path / "index")]) == 0
    assert main(["ingest", str(tmp_path / "in"), str(tmp_path / "index")]) == 0
    index = Index(spark, str(tmp_path / "index"))
    assert index.count("chunks") == 2 and not index.is_empty() and index.table("chunks").where("chunk_no = 0").first().filename == "a.txt"
    q = spark.createDataFrame([(1, "red fox"), (2, "")], "query_id long, query string")
    hits = index.retrieve(q).where("query_id = 1").orderBy("rank").collect()
    assert hits[0].filename == "b.md" and hits[0].text.startswith("The red fox") and "graph" in hits[0].found_in
    assert {r.query_id for r in index.retrieve(q).collect()} == {1}
    assert main(["query", str(tmp_path / "index"), "red fox"]) == 0 and main(["compare", str(tmp_path / "index"), "red fox"]) == 0


def test_index_without_a_readable_graph(spark, tmp_path):
    from brindle.operators.index import Index, build_indexes

    build_indexes(spark.createDataFrame([(1, "red fox runs"), (2, "lazy dog"), (3, None), (4, "some more words"), (5, "and others")], "chunk_no long, text string"), str(tmp_path))
    q = spark.createDataFrame([(1, "red fox")], "query_id long, query string")
    assert "graph" in Index(spark, str(tmp_path)).hybrid(q).first().found_in
    for f in (tmp_path / "edges").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    for f in (tmp_path / "edges").glob(".*.crc"):
        f.unlink()
    assert Index(spark, str(tmp_path)).hybrid(q).first().found_in == "vector,bm25"
    import shutil

    shutil.rmtree(tmp_path / "terms")
    with pytest.raises(FileNotFoundError):
        Index(spark, str(tmp_path)).bm25(q)


def test_knn_in_tiles_equals_one_scan(spark, monkeypatch):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [round(rng.gauss(0, 1), 1) for _ in range(4)]) for i in range(300)], "chunk_no long, v array<double>")
    q = v.where("chunk_no < 40").select(F.col("chunk_no").alias("query_id"), "v")
    want = {tuple(r) for r in R.knn(v.repartition(3), q, 5, 4).select("query_id", "chunk_no", "rank").collect()}
    monkeypatch.setattr(R, "BLOCK", 16)
    monkeypatch.setattr(R, "TILE", 70)
    assert {tuple(r) for r in R.knn(v, q, 5, 4).select("query_id", "chunk_no", "rank").collect()} == want and len(want) == 200


def test_byte_pair_windows(spark):
    from brindle.operators.providers import BytePairs

    text = "naïve words and 東京 make tokens " * 40
    docs = spark.createDataFrame([(1, "f.md", text), (2, "f.md", None), (3, "f.md", " ")], "doc_id long, filename string, text string")
    got = chunking.chunk_documents(docs, 50, 10, tokenizer=BytePairs()).orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {1} and len(got) > 4 and all(r.text in text for r in got) and got[0].total_chunks == len(got)


def test_phrases(spark):
    from brindle.operators.providers import Phrases

    rows = spark.createDataFrame([("The old red fox of the north is tired. A lazy dog",)], "t string").select(Phrases().signals(F.col("t")).alias("s")).first().s
    assert {r.sid for r in rows if r.sid.startswith("np_")} == {"np_old red fox", "np_old red", "np_red fox", "np_lazy dog"}


def test_models(spark):
    from brindle.operators import models, prompts

    calls = spark.sparkContext.accumulator(0)

    def shaky(texts):
        calls.add(1)
        raise RuntimeError("busy")

    q = spark.createDataFrame([(1, "red fox"), (2, "dog")], "query_id long, query string").coalesce(1)
    out = models.ask(q, F.col("query"), shaky, tries=2, pause=0.01).collect()
    assert calls.value == 2 and all(r.reply is None and "busy" in r.reply_error for r in out)
    assert [r.query for r in models.hypothetical(q, models.echo).orderBy("query_id").collect()] == ["This passage is about red fox", "This passage is about dog"]
    assert [r.question for r in models.decomposed(q.limit(1), lambda ts: ['["a", "b"]'] * len(ts)).collect()] == ["a", "b"]
    assert models.routed(q.limit(1), lambda ts: ["Complex."] * len(ts)).first().route == "complex"
    assert models.reformulated(q.limit(1), lambda ts: [" "] * len(ts)).first().query == "red fox"
    hits = spark.createDataFrame([(1, "q", 1, "a_chunk_00002", "one two"), (1, "q", 2, "a_chunk_00005", "x")], "query_id long, query string, rank int, chunk_id string, text string")
    r = models.grounded(hits, lambda ts: ["It is so [C5]. And so [C2][C9][C5]."] * len(ts)).first()
    assert r.cited == ["a_chunk_00005", "a_chunk_00002"] and not r.insufficient
    assert models.grounded(hits, lambda ts: ["INSUFFICIENT_CONTEXT [C2]"] * len(ts)).first().cited == []
    judged = models.judged(spark.createDataFrame([(1, "c", "Good. Bad one.")], "query_id long, context string, answer string"), lambda ts: ['{"verdict": "partial", "unsupported_sentences": ["Bad one."]}'])
    assert judged.first().answer == "Good."
    with pytest.raises(KeyError):
        prompts.fill("{missing}", query=F.lit(1))
    assert values(spark, prompts.fill("{{{t}}} {t}", t=F.col("t")), ("x",), (None,)) == ["{x} x", "{} "]


def test_hot_key_join(spark):
    from brindle.plans.physical import join_facts

    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    out = join_facts(rows, rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert out.count() == 1000 and out.where("k = 'hot'").agg(F.min("n"), F.max("n")).first() == (900, 900)


def test_file_order(spark):
    docs = spark.createDataFrame([(f"/{i % 7}/{i}.txt",) for i in range(100)], "path string").repartition(5)
    got = files.in_order(docs).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.ordinal)] == sorted(r.path for r in got) and sorted(r.ordinal for r in got) == list(range(100))
    assert files.in_order(docs.where("false")).count() == 0


def test_answers(spark, tmp_path):
    from brindle.operators import models
    from brindle.operators.index import Index, build_indexes
    from brindle.plans import pipeline

    texts = ["the red fox runs over the frozen lake in winter", "lazy dogs sleep beside the warm oven at night", "a bird flew south", "bread needs flour", "rivers run to the sea", "stones are heavy"]
    build_indexes(spark.createDataFrame([(i, f"f{i}_chunk_{i:05d}", t) for i, t in enumerate(texts)], "chunk_no long, chunk_id string, text string"), str(tmp_path))
    asked = [(1, "red fox runs"), (2, "hello"), (3, "frozen lake winter and warm oven night"), (4, "quantum banana theory"), (5, "red fox runs xylophone zeppelin")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    got = {r.query_id: r for r in pipeline.answer_queries(Index(spark, str(tmp_path)), q, models.stand_in).collect()}
    assert {i: r.route for i, r in got.items()} == {1: "simple", 2: "direct", 3: "complex", 4: "simple", 5: "simple"}
    assert got[1].citations == ["f0_chunk_00000"] and got[1].confidence == "pass" and got[1].answer.startswith("the red fox")
    assert got[3].confidence == "pass" and len(got[3].citations) == 1
    assert got[4].answer == pipeline.REFUSED and got[4].citations == [] and got[4].confidence == "refused"
    assert got[5].retries == 0 and got[2].citations == []
    def strict(texts):
        return ['{"verdict": "fail"}' if t.startswith("Which sentences") else models.stand_in([t])[0] for t in texts]

    assert {r.confidence for r in pipeline.answer_queries(Index(spark, str(tmp_path)), q.where("query_id = 1"), strict).collect()} == {"refused"}


def test_state_merge(spark):
    from brindle.plans.pipeline import merge

    state = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "query_id long, x string, y int")
    out = merge(state, spark.createDataFrame([(2, None, "new")], "query_id long, x string, z string")).orderBy("query_id").collect()
    assert [tuple(r) for r in out] == [(1, "a", 1, None), (2, None, 2, "new")]


def test_items_are_counted_in_the_jvm(spark):
    rows = [(1, ["b", "a", "b", "b", ""]), (2, []), (3, None), (4, ["x"])]
    out = R.count_in_rows(spark.createDataFrame(rows, "chunk_no long, t array<string>"), "chunk_no")
    assert sorted(map(tuple, out.collect())) == [("", 1, 1, 5), ("a", 1, 1, 5), ("b", 1, 3, 5), ("x", 4, 1, 1)]
    for df in (R.postings(corpus(spark)), R.contains_edges(corpus(spark))):  # a Python worker would hold the items of thousands of rows
        assert "Arrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_the_tables_asked_for_are_built(spark, tmp_path):
    from brindle.operators.index import SCHEMAS, Index, build_indexes

    q = spark.createDataFrame([(1, "red fox runs"), (2, "lazy dog")], "query_id long, query string")
    chunks = spark.createDataFrame([(1, "red fox runs"), (2, "lazy dog"), (3, None), (4, "red fox runs on"), (5, "and others")], "chunk_no long, text string")
    index = Index(spark, str(tmp_path / "some"), chunks=chunks)
    there = lambda: sorted(p.name for p in (tmp_path / "some").iterdir())
    index.bm25(q).collect()
    assert there() == ["corpus", "postings", "terms"]
    got = sorted(map(tuple, index.graph(q).collect()))
    assert there() == ["corpus", "edges", "postings", "terms"]
    build_indexes(chunks, str(tmp_path / "all"))
    whole = Index(spark, str(tmp_path / "all"))
    assert got == sorted(map(tuple, whole.graph(q).collect())) and len(got) > 2
    for name in SCHEMAS:
        assert sorted(map(tuple, index.table(name).collect()), key=repr) == sorted(map(tuple, whole.table(name).collect()), key=repr)
    assert there() == sorted(SCHEMAS)


def test_best_of_many_vectors_met_in_parts(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(5)
    q, x = rnd.normal(size=(7, 8)), rnd.normal(size=(1000, 8)).round(1)
    held = []
    monkeypatch.setattr(R, "SCORES", 700)
    for most in (700, 10**9):
        monkeypatch.setattr(R, "SCORES", most)
        best = R._Best(np.arange(7), q, 5)
        best.meet(np.arange(1000), x)
        held.append((best.ids.tolist(), best.scores.round(9).tolist()))
    assert held[0] == held[1]


def test_graph_search_from_texts_stores_no_edges(spark, tmp_path):
    from brindle.operators.index import Index, build_indexes

    q = spark.createDataFrame([(1, "red fox runs on"), (2, "lazy dog"), (3, "")], "query_id long, query string")
    more = spark.createDataFrame([(4, "red fox runs"), (5, "Big Ben and others")], "query_id long, query string")
    chunks = spark.createDataFrame([(1, "red fox runs red fox runs"), (2, "12lazy dog"), (3, None), (4, "Red Fox runs on"), (5, "and others of Big Ben"), (6, "Red Fox, a red fox"), (7, "")], "chunk_no long, text string")
    index = Index(spark, str(tmp_path / "some"), chunks=chunks, from_texts=True)
    build_indexes(chunks, str(tmp_path / "all"))
    whole = Index(spark, str(tmp_path / "all"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for asked, passes in ((q, 1), (q, 1), (q.where("query_id = 2"), 1), (more, 2)):  # the texts are read again only for new signals
        assert rows(index.graph(asked)) == rows(whole.graph(asked)) and len(index.met) == passes
    assert len(rows(index.graph(more))) > 2
    assert not (tmp_path / "some").exists() and rows(R.graph_search(chunks, q)) == rows(whole.graph(q))
    index.table("edges")
    assert rows(index.graph(q)) == rows(whole.graph(q)) and len(index.met) == 2


def test_edges_of_some_signals_equal_those_of_all(spark, monkeypatch):
    from brindle.operators.providers import Phrases, Providers

    texts = ["the red fox runs the red fox runs on", "12Big Ben of Big Ben", "a", "", None, "one two", "two  one two three", "NP_ x Ent_ y np_one two"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_no long, text string")
    for providers in (Providers(), Providers(extractor=Phrases())):
        every = R.contains_edges(chunks, providers).select("sid", "chunk_no")
        sids = every.select("sid").distinct().where("hash(sid) % 2 = 0")
        for most in (R.MARKS, 0):
            monkeypatch.setattr(R, "MARKS", most)
            got = sorted(map(tuple, R.edges_of(chunks, sids, providers).collect()))
            assert got == sorted(map(tuple, every.join(sids, "sid").collect())) and got
        monkeypatch.undo()
    assert R.edges_of(chunks, every.select("sid").where("false")).count() == 0


def test_registered_searches_store_no_edges(spark, tmp_path, monkeypatch):
    from brindle.plans import catalog

    monkeypatch.setattr(catalog, "shared_folder", lambda _: str(tmp_path / "shared"))
    rows = [(i, f"f{i}", f"word{i % 3} common words of text {i}", "s", f"f{i}", "text", 0, 1, i) for i in range(30)]
    spark.createDataFrame(rows, "chunk_no long, chunk_id string, text string, source string, filename string, doc_type string, chunk_index int, total_chunks int, doc_id long").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(1, "common words of text 7"), (2, "word1 common")], "query_id long, query string").write.parquet(str(tmp_path / "query_catalog.parquet"))
    assert catalog.QUERIES["q17_graph_only"](spark, str(tmp_path)).count() == 10 and catalog.QUERIES["q16_hybrid_retrieve"](spark, str(tmp_path)).count() == 10
    assert not list((tmp_path / "shared").glob("*/edges"))


def test_compare_flags_searches_once(spark, tmp_path, monkeypatch):
    from brindle.plans import catalog

    monkeypatch.setattr(catalog, "shared_folder", lambda _: str(tmp_path / "shared"))
    rows = [(i, f"f{i}", f"word{i % 3} common words of text {i}", "s", f"f{i}", "text", 0, 1, i) for i in range(30)]
    spark.createDataFrame(rows, "chunk_no long, chunk_id string, text string, source string, filename string, doc_type string, chunk_index int, total_chunks int, doc_id long").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(1, "common words of text 7"), (2, "word1 common")], "query_id long, query string").write.parquet(str(tmp_path / "query_catalog.parquet"))
    out = catalog.QUERIES["q39_compare_flags"](spark, str(tmp_path))
    assert "FileScan" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" not in plan
    hits = {(r.mode, r.query_id, r.chunk_no): r.in_other for r in out.collect()}
    assert len(hits) == 20 and all(seen == (("graph" if mode == "vector_bm25" else "vector_bm25", q, c) in hits) for (mode, q, c), seen in hits.items())

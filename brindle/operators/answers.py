"""The deterministic envelope of model answers: parsing, context, citations and sentence removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import collapse, short_id, unfence

ROUTES = ("direct", "simple", "complex")
SEPARATOR = "\n\n---\n\n"


def route_of(raw: Column, strict: bool = False) -> Column:
    """A route label from model text: a bare word, or (unless ``strict``) the ``route`` of a JSON object; anything else is ``simple``."""
    word = F.regexp_replace(F.lower(F.trim(raw)), r"[.,!? \n]+$", "")
    if not strict:
        named = F.lower(F.regexp_extract(raw, r'"route"\s*:\s*"([A-Za-z]+)"', 1))
        word = F.when(named != "", named).otherwise(word)
    return F.when(word.isin(*ROUTES), word).otherwise("simple")


def sub_questions(raw: Column, query: Column) -> Column:
    """The strings of a JSON array, code fences allowed; the query itself where the text is none."""
    clean = unfence(raw)
    parsed = F.when(clean.rlike(r"(?s)^\[.*\]$"), F.from_json(clean, "array<string>"))
    return F.coalesce(parsed, F.array(query))


def labelled(hits: DataFrame) -> DataFrame:
    """Hits with ``label``, their short id, or their place where two hits of a query would share one."""
    out = hits.withColumn("label", short_id(F.col("chunk_id"), F.col("rank") - 1))
    clash = F.count("*").over(Window.partitionBy("query_id", "label")) > 1
    return out.withColumn("label", F.when(clash, F.concat(F.lit("C#"), F.col("rank").cast("string"))).otherwise(F.col("label")))


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): the texts of hits (query_id, rank, chunk_id, text) in rank order, each under its short id."""
    part = F.struct("rank", F.concat(F.lit("["), "label", F.lit("]\n"), "text").alias("part"))
    return labelled(hits).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.part), SEPARATOR).alias("context"))


INSUFFICIENT = "INSUFFICIENT_CONTEXT"


def insufficient(answer: Column) -> Column:
    """Whether an answer says, anywhere, that the context doesn't do; a null one does not."""
    return F.coalesce(F.contains(answer, F.lit(INSUFFICIENT)), F.lit(False))


def result(state: DataFrame) -> DataFrame:
    """(run_id, answer, citations, route, confidence) of finished runs; missing values are empty, a missing confidence is ``none``."""
    return state.select(
        "run_id", F.coalesce("answer", F.lit("")).alias("answer"), F.array_join(F.coalesce("citations", F.array().cast("array<string>")), ",").alias("citations"),
        F.coalesce("route", F.lit("")).alias("route"), F.coalesce("confidence", F.lit("none")).alias("confidence"),
    )


def cited(answer: Column) -> Column:
    """Short ids ``C<number>`` an answer cites in brackets, each once, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[C(\d+)\]"), 1), lambda n: F.concat(F.lit("C"), n)))


def drop_sentences(answer: Column, unsupported: Column) -> Column:
    """The answer without the given sentences, white space collapsed."""
    return collapse(F.aggregate(unsupported, answer, lambda a, s: F.trim(F.replace(a, s, F.lit("")))))


def critic(raw: Column) -> Column:
    """struct(verdict, unsupported_sentences) of a critic's JSON; ``pass`` where it can't be read."""
    parsed = F.from_json(unfence(raw), "verdict string, unsupported_sentences array<string>")
    return F.struct(F.coalesce(parsed.verdict, F.lit("pass")).alias("verdict"), F.coalesce(parsed.unsupported_sentences, F.array().cast("array<string>")).alias("unsupported_sentences"))


def gate(score: Column, n: Column, passing: float = 0.0, retrying: float = -3.0) -> Column:
    """pass, retry or refuse by the best rerank score; no rows refuse, a missing score passes."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "refuse").when(s >= passing, "pass").when(s >= retrying, "retry").otherwise("refuse")

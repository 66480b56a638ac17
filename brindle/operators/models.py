"""Steps that ask a language model, which is any function from a list of prompts to a list of replies."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import answers as A, prompts

Model = Callable[[list[str]], list[str]]


def ask(df: DataFrame, prompt, model: Model, reply: str = "reply", tries: int = 3, pause: float = 15.0) -> DataFrame:
    """``df`` with the model's reply to each prompt, asked for a batch of rows at a time where they lie.

    A batch that fails is asked again, ``tries`` times in all, after n times ``pause`` seconds; then its
    rows have a null reply and ``<reply>_error``. The model must be picklable.
    """
    asked = df.withColumn("_prompt", prompt)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            out, error = [None] * len(texts), None
            for n in range(1, tries + 1):
                try:
                    out, error = list(model(texts)), None
                    if len(out) != len(texts):
                        raise ValueError(f"{len(out)} replies to {len(texts)} prompts")
                    break
                except Exception as e:  # noqa: BLE001
                    out, error = [None] * len(texts), f"{type(e).__name__}: {e}"
                    if n < tries:
                        time.sleep(pause * n)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.string()), pa.array([error] * len(texts), pa.string())], [*names, reply, f"{reply}_error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return asked.mapInArrow(run, f"{fields}, `{reply}` string, `{reply}_error` string")


def hypothetical(queries: DataFrame, model: Model, templates: dict[str, str] = prompts.TEMPLATES) -> DataFrame:
    """(query_id, query): a passage that might answer each query, to search with; the query itself where the model fails."""
    out = ask(queries.select("query_id", "query"), prompts.fill(templates["hypothetical"], query=F.col("query")), model)
    return out.select("query_id", F.coalesce("reply", "query").alias("query"))


def decomposed(queries: DataFrame, model: Model, templates: dict[str, str] = prompts.TEMPLATES) -> DataFrame:
    """(query_id, sub, question): the parts a model cuts each query into; the query itself where that can't be read."""
    out = ask(queries.select("query_id", "query"), prompts.fill(templates["decompose"], query=F.col("query")), model)
    return out.select("query_id", F.posexplode(A.sub_questions(F.col("reply"), F.col("query"))).alias("sub", "question"))


def routed(queries: DataFrame, model: Model, templates: dict[str, str] = prompts.TEMPLATES) -> DataFrame:
    """(query_id, query, route); ``simple`` where the model fails."""
    out = ask(queries.select("query_id", "query"), prompts.fill(templates["route"], query=F.col("query")), model)
    return out.select("query_id", "query", A.route_of(F.col("reply")).alias("route"))


def reformulated(queries: DataFrame, model: Model, templates: dict[str, str] = prompts.TEMPLATES) -> DataFrame:
    """(query_id, query): the original query in other words; as it was where the model fails."""
    out = ask(queries.select("query_id", "query"), prompts.fill(templates["reformulate"], query=F.col("query")), model)
    return out.select("query_id", F.coalesce(F.nullif(F.trim("reply"), F.lit("")), F.col("query")).alias("query"))


def direct(queries: DataFrame, model: Model, templates: dict[str, str] = prompts.TEMPLATES) -> DataFrame:
    """(query_id, answer) without documents."""
    return ask(queries.select("query_id", "query"), prompts.fill(templates["direct"], query=F.col("query")), model).select("query_id", F.col("reply").alias("answer"))


def grounded(hits: DataFrame, model: Model, templates: dict[str, str] = prompts.TEMPLATES) -> DataFrame:
    """(query_id, context, answer, cited, insufficient) from hits (query_id, query, rank, chunk_id, text).

    cited are the chunk ids of the short ids the answer names, in order of first appearance; ids that
    the context doesn't have are dropped. A failed or insufficient answer cites nothing.
    """
    labelled = A.labelled(hits)
    part = F.struct("rank", "label", "chunk_id")
    ids = labelled.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(part)).alias("ids"))  # top-k rows a query
    asked = ids.join(A.context(hits), "query_id")
    out = ask(asked, prompts.fill(templates["answer"], query=F.col("query"), context=F.col("context")), model, "answer")
    of = lambda short: F.element_at(F.filter("ids", lambda x: x.label == short), 1).chunk_id
    named = F.array_compact(F.transform(A.cited(F.coalesce("answer", F.lit(""))), lambda c: F.when(F.exists("ids", lambda x: x.label == c), of(c))))
    bad = A.insufficient(F.col("answer"))
    return out.select("query_id", "context", "answer", F.when(bad, F.array().cast("array<string>")).otherwise(named).alias("cited"), bad.alias("insufficient"))


def judged(answers: DataFrame, model: Model, templates: dict[str, str] = prompts.TEMPLATES) -> DataFrame:
    """(query_id, answer, verdict, unsupported_sentences) of answers (query_id, context, answer), the unsupported sentences removed."""
    out = ask(answers.select("query_id", "context", "answer"), prompts.fill(templates["critic"], context=F.col("context"), answer=F.col("answer")), model)
    out = out.withColumn("c", A.critic(F.col("reply")))
    mended = F.when((F.col("c.verdict") == "partial") & (F.size("c.unsupported_sentences") > 0), A.drop_sentences(F.col("answer"), F.col("c.unsupported_sentences"))).otherwise(F.col("answer"))
    return out.select("query_id", mended.alias("answer"), "c.verdict", "c.unsupported_sentences")


def echo(texts: list[str]) -> list[str]:
    """A stand-in: a passage made of the question's own words."""
    return ["This passage is about " + t.rsplit("Question: ", 1)[-1] for t in texts]


def first_source(texts: list[str]) -> list[str]:
    """A stand-in: the first ten words of the first source, with its id; INSUFFICIENT_CONTEXT where there is no source."""
    out = []
    for t in texts:
        m = re.search(r"\[(C\d+)\]\n([^\n]*)", t.split("INSUFFICIENT_CONTEXT.\n\n", 1)[-1])
        out.append(f"{' '.join(m.group(2).split(' ')[:10])} [{m.group(1)}]." if m else A.INSUFFICIENT)
    return out


def stand_in(texts: list[str]) -> list[str]:
    """A stand-in for every step, told apart by the words of the default templates."""
    out = []
    for t in texts:
        question = t.rsplit("Question: ", 1)[-1]
        words = question.split()
        if t.startswith("Say how"):
            out.append(json.dumps({"route": "direct" if len(words) < 3 else "complex" if " and " in question else "simple"}))
        elif t.startswith("Write a short passage"):
            out += echo([t])
        elif t.startswith("Part the question"):
            out.append(json.dumps(question.split(" and ")))
        elif t.startswith("The search"):
            out.append(" ".join(words[: max(1, len(words) - 1)]))
        elif t.startswith("Answer from"):
            out += first_source([t])
        elif t.startswith("Which sentences"):
            out.append('{"verdict": "pass", "unsupported_sentences": []}')
        else:
            out.append("No documents are needed for that.")
    return out

"""Prompt catalogue: named templates with holes in braces, filled on columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "route": "Say how a question is to be answered: direct (no documents needed), simple (one search) or complex (several).\nReply with JSON: {{\"route\": \"...\"}}\nQuestion: {query}",
    "hypothetical": "Write a short passage, as a document might have it, that would answer this.\nQuestion: {query}",
    "decompose": "Part the question into two to four that can be searched for one by one. Reply with a JSON array of strings.\nQuestion: {query}",
    "reformulate": "The search for this question found too little. Word it differently, in one line.\nQuestion: {query}",
    "answer": "Answer from the sources only, and name the source in brackets after each sentence, such as [C3].\nIf they don't do, reply INSUFFICIENT_CONTEXT.\n\n{context}\n\nQuestion: {query}",
    "critic": "Which sentences of the answer aren't borne out by the sources? Reply with JSON: {{\"verdict\": \"pass|partial|fail\", \"unsupported_sentences\": []}}\n\n{context}\n\nAnswer: {answer}",
    "direct": "Answer briefly.\nQuestion: {query}",
}

_HOLE = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def load(path: str) -> dict[str, str]:
    """A catalogue kept as a JSON object of strings."""
    found = json.load(open(path, encoding="utf-8"))
    if not isinstance(found, dict) or not all(isinstance(v, str) for v in found.values()):
        raise ValueError(f"{path} isn't a JSON object of strings")
    return found


def fill(template: str, **holes: Column) -> Column:
    """The template with its holes filled; doubled braces are braces, nulls fill nothing, a hole without a column is an error."""
    parts, at = [], 0
    for m in _HOLE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        if m.group(1):
            if m.group(1) not in holes:
                raise KeyError(m.group(1))
            parts.append(F.coalesce(holes[m.group(1)].cast("string"), F.lit("")))
        else:
            parts.append(F.lit(m.group()[0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))

"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\r\f\x0B]+"


def tokens(c: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty array for blank text."""
    return F.filter(F.split(F.lower(c), WHITE), lambda x: x != "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, WHITE), lambda x: x != "")


def collapse(c: Column) -> Column:
    return F.array_join(words(c), " ")


def strip_glued_digits(c: Column) -> Column:
    """Digits stuck to the front of a word go: ``13Combination`` becomes ``Combination``."""
    return F.regexp_replace(c, r"(^|[^\p{L}\p{N}_])\d+([A-Za-z])", "$1$2")


def ngrams(ws: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Runs of consecutive words, joined by a space."""
    def runs_of(k: int) -> Column:
        return F.transform(F.slice(ws, 1, F.size(ws) - (k - 1)), lambda w, i: F.concat_ws(" ", w, *[F.get(ws, i + j) for j in range(1, k)]))

    parts = []
    for k in sizes:
        runs = runs_of(k)
        parts.append(F.when(F.size(ws) >= k, runs).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def subphrases(phrase: Column) -> Column:
    """Runs of two or three words shorter than the phrase itself."""
    ws = words(phrase)
    return F.filter(ngrams(ws), lambda x: F.size(F.split(x, " ")) < F.size(ws))


def capitalised(c: Column) -> Column:
    """Runs of capitalised ASCII words: the default stand-in for a named-entity model."""
    return F.regexp_extract_all(c, F.lit(r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), 1)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-]", "_")


def short_id(chunk_id: Column, position: Column) -> Column:
    """``C<number>`` from the id's end, else from the position counted from 1."""
    n = F.regexp_extract(chunk_id, r"chunk_(\d+)$", 1)
    return F.concat(F.lit("C"), F.when(n != "", n.cast("bigint").cast("string")).otherwise((position + 1).cast("string")))


def unfence(c: Column) -> Column:
    """Without Markdown code fences."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), r"^\s+|\s+$", "")


def preview(c: Column, width: int = 70) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)

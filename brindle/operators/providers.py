"""What stands in for models: encoder, signal extractor, reranker and tokenizer, each replaceable by another with the same method."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import capitalised, ngrams, strip_glued_digits, tokens, words


class Encoder(Protocol):
    dim: int

    def vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, v ARRAY<DOUBLE>) of unit length; no row for a text that has none."""


class Extractor(Protocol):
    def signals(self, text: Column) -> Column:
        """ARRAY<STRUCT<sid, label>> of a text: entities ``ent_...`` with a label and concepts ``np_...`` without, repeats of concepts included."""


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column:
        """DOUBLE, the greater the better; 0 is what still passes the gate."""


class Tokenizer(Protocol):
    def windows(self, df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
        """``df`` with ``parts`` ARRAY<STRING>: the text's windows of ``size`` tokens, each ``overlap`` into the last."""


MEMO = 500_000
SLICE = 1024  # rows whose words a task holds at a time


class _Buckets(dict):
    """Word -> the first 32 bits of its MD5, modulo the number of buckets; emptied when full."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = b = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4], "big") % self.dim
        return b


@dataclass(frozen=True)
class HashedWords:
    """Bag of words in hash buckets, unit length: a deterministic stand-in for a sentence encoder."""

    dim: int = 64

    def vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        t = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
        dim, kind = self.dim, df.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket = _Buckets(dim).__getitem__
            for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
                if n := b.num_rows:
                    lists = b.column(1)
                    coded = lists.flatten().dictionary_encode()  # a word's bucket is looked up once a slice
                    at = np.fromiter(map(bucket, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]
                    rows = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                    x = np.bincount(rows * dim + at, minlength=n * dim).reshape(n, dim).astype(np.float64)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(x.reshape(-1)))], ["k", "v"])

        return t.mapInArrow(run, f"k {kind}, v array<double>").withColumnRenamed("k", key)


@dataclass(frozen=True)
class CapitalsAndRuns:
    """Capitalised runs as entities, runs of two and three words as concepts."""

    def signals(self, text: Column) -> Column:
        ents = F.transform(F.array_distinct(F.transform(capitalised(text), F.lower)), lambda e: F.struct(F.concat(F.lit("ent_"), e).alias("sid"), F.lit("CAP").alias("label")))
        nps = F.transform(ngrams(F.col("w")), lambda g: F.struct(F.concat(F.lit("np_"), g).alias("sid"), F.lit(None).cast("string").alias("label")))
        return F.concat(ents, nps)

    def mark(self, sid: Column) -> Column:
        """The hash of a concept's words."""
        return F.xxhash64(F.split(F.regexp_replace(sid, "^np_", ""), " "))

    def likely(self, text: Column, marks: list[int]) -> Column:
        """ARRAY<STRING>: sids of all entities, and of those concepts whose ``mark`` is among ``marks``; the other runs of words are only hashed."""
        ents = F.transform(capitalised(text), lambda e: F.concat(F.lit("ent_"), F.lower(e)))

        def runs(k: int) -> Column:
            def put(w: Column, i: Column) -> Column:
                run = [w, *(F.get("w", i + j) for j in range(1, k))]  # null where the text ends, and so is what is put together
                return F.when(F.xxhash64(*run).isin(marks), F.concat(F.lit("np_"), w, *(x for y in run[1:] for x in (F.lit(" "), y))))

            return F.filter(F.transform("w", put), lambda x: x.isNotNull())

        return F.concat(ents, runs(2), runs(3))


STOP = tuple("a an the of in on at by for to from with and or nor but as is are was were be been being it its this that these those which who whom whose will would shall should may might can could must not no do does did has have had than then there here".split())


@dataclass(frozen=True)
class Phrases:
    """Capitalised runs as entities; as concepts, runs of at least two words between stop words and marks, and their shorter runs of two and three words.

    A stand-in for a noun-phrase parser: it gives a graph of a size near the number of phrases, not of all word runs.
    """

    stop: tuple[str, ...] = STOP

    def signals(self, text: Column) -> Column:
        ents = F.transform(F.array_distinct(F.transform(capitalised(text), F.lower)), lambda e: F.struct(F.concat(F.lit("ent_"), e).alias("sid"), F.lit("CAP").alias("label")))
        cut = F.regexp_replace(F.lower(text), r"(?:^|(?<=[\s|]))(?:" + "|".join(self.stop) + r")(?=[\s|]|$)|[^\p{L}\p{N}\s'-]+", "|")
        phrases = F.filter(F.transform(F.split(cut, r"\|"), lambda p: F.array_join(words(p), " ")), lambda p: F.size(F.split(p, " ")) >= 2)
        every = F.flatten(F.transform(phrases, lambda p: F.array_union(F.array(p), ngrams(F.split(p, " ")))))
        return F.concat(ents, F.transform(every, lambda g: F.struct(F.concat(F.lit("np_"), g).alias("sid"), F.lit(None).cast("string").alias("label"))))


@dataclass(frozen=True)
class WordOverlap:
    """Share of the query's distinct words found in the text, on the scale -10 to 10: a stand-in for a cross-encoder."""

    def score(self, query: Column, text: Column) -> Column:
        asked = F.array_distinct(tokens(query))
        return F.round(F.try_divide(F.size(F.array_intersect(asked, tokens(text))) * F.lit(20.0), F.size(asked)) - 10.0, 6)


@dataclass(frozen=True)
class WhiteSpace:
    """Words between ASCII white space, put together again with one space."""

    def windows(self, df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
        step = size - overlap
        count = F.when(F.size("w") <= size, F.lit(1)).otherwise(1 + F.ceil((F.size("w") - size) / F.lit(float(step))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.array_join(F.slice(F.col("w"), k * step + 1, size), " "))
        out = df.where(F.col(text).isNotNull()).withColumn("w", words(F.col(text))).where(F.size("w") > 0).withColumn("n", count)
        return out.withColumn("parts", parts).drop("w", "n")


@dataclass(frozen=True)
class BytePairs:
    """Tokens of a public byte-level vocabulary file; windows are decoded to text, halves of characters at their edges left out."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def windows(self, df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
        raw, pattern, step = df.sparkSession.sparkContext.broadcast(open(self.vocabulary, "rb").read()), self.pattern, size - overlap

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines())}
            own = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for b in batches:
                parts = []
                for t in b.column(b.schema.get_field_index(text)).to_pylist():
                    ids = own.encode_ordinary(t)
                    n = 1 if len(ids) <= size else 1 + -(-(len(ids) - size) // step)
                    parts.append([own.decode_bytes(ids[k * step : k * step + size]).decode("utf-8", "ignore") for k in range(n)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.list_(pa.string()))], [*b.schema.names, "parts"])

        some = df.where(F.col(text).rlike(r"\S"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields)
        return some.mapInArrow(run, f"{fields}, parts array<string>")


def cleaned(df: DataFrame, key: str, text: Column, query: bool, extractor: Extractor | Callable[[Column], Column]) -> DataFrame:
    """(key, s ARRAY<STRUCT<sid, label>>, or what ``extractor`` makes if it is a function); digits glued to words go from chunks, not from queries."""
    signals = extractor if callable(extractor) else extractor.signals
    base = df.select(F.col(key).alias(key), text.alias("t")).where("t is not null")
    clean = base.select(key, (F.col("t") if query else strip_glued_digits(F.col("t"))).alias("t"))
    return clean.select(key, "t", tokens(F.col("t")).alias("w")).select(key, signals(F.col("t")).alias("s"))  # words are worked out once


@dataclass(frozen=True)
class Providers:
    encoder: Encoder = field(default_factory=HashedWords)
    extractor: Extractor = field(default_factory=CapitalsAndRuns)
    reranker: Reranker = field(default_factory=WordOverlap)
    tokenizer: Tokenizer = field(default_factory=WhiteSpace)


DEFAULTS = Providers()

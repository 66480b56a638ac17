"""Near-duplicate joins: word shingles under Jaccard, and short strings under edit distance.

Both order the tokens of each record rare first, join records on their prefixes, prune by length,
position and suffix, and verify each remaining pair once. Records whose token sets are equal are folded
into one before the join and unfolded after it, so a large group of copies costs one record.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrow import column, map_batches, strings
from brindle.llm.sketches import IdFilter, hashed_counts, rarity
from brindle.plans.physical import cut_lineage, join_facts

COUNT_BITS, MOST_BITS = 22, 24  # of the table of shingle counts: for FEW texts, and at most
FEW = 400_000
SHARED = 4
HOT = 512  # occurrences from which a shingle is joined by bands of lengths
BAND = math.log(1.1)
WORD_MEMO = 500_000
ROWS = 1024  # texts whose words and shingles a task holds at a time
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > WORD_MEMO:
            self.clear()
        self[word] = h
        return h


_words = _WordHash()


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes."""
    out = h[: len(h) - n + 1] * _M1
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _M2 + h[k : len(h) - n + 1 + k] * _M3
    out ^= out >> np.uint64(32)
    out *= _M1
    return out ^ (out >> np.uint64(29))


def shingle_hashes(texts: list[str | None], n: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, ends, hashes): of each text with at least ``least_words`` words (and n), all runs of n words, repeats too."""
    rows, sizes, flat = [], [], []
    least = max(n, least_words)
    for i, t in enumerate(texts):
        if t is None:
            continue
        words = t.lower().split()
        if len(words) >= least:
            rows.append(i)
            sizes.append(len(words))
            flat += words
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, flat), dtype=np.uint64, count=len(flat))
    sizes = np.array(sizes)
    mixed = _mixed(h, n)
    ends = np.cumsum(sizes)
    keep = np.ones(len(h), dtype=bool)
    for k in range(1, n):
        keep[ends - k] = False
    return np.array(rows), np.cumsum(sizes - n + 1), mixed[keep[: len(mixed)]]


def _sets(texts: list[str | None], order: np.ndarray, n: int, least_words: int):
    """(row, sorted distinct keys) of each long enough text. A key is its rarity byte over 56 bits of the hash: sorting puts the rare first."""
    rows, ends, h = shingle_hashes(texts, n, least_words)
    keys = (order[(h & np.uint64(len(order) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    start = 0
    for row, end in zip(rows.tolist(), ends.tolist()):
        yield row, np.unique(keys[start:end])
        start = end


def count_bits(texts: int) -> int:
    """The count table's buckets grow with the texts, so that a rare shingle doesn't look common for those that share its bucket."""
    return min(max(COUNT_BITS, MOST_BITS), COUNT_BITS + max(0, math.ceil(math.log2(max(1, texts) / FEW))))


def _prefix(size: int, t: float) -> int:
    return min(size, size - math.ceil(t * size - 1e-9) + SHARED)


def _band(size: int) -> int:
    return int(math.log(size) / BAND + 1e-9)


def _banded(keys: np.ndarray, band: int) -> np.ndarray:
    return _mixed(keys, 1) ^ _mixed(np.full(len(keys), band + 1, np.uint64), 1)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """Upper bound of the overlap of two sorted arrays: split both at the middle of x, and again, adding what the sizes allow."""
    if not depth or not len(x) or not len(y):
        return min(len(x), len(y))
    m = len(x) // 2
    k = int(np.searchsorted(y, x[m]))
    same = int(k < len(y) and y[k] == x[m])
    return suffix_bound(x[:m], y[:k], depth - 1) + same + suffix_bound(x[m + 1 :], y[k + same :], depth - 1)


def fold_equal(signed: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(members, copies, records, number of copies) of rows (id, sig).

    members (rep, id): rows of one sig share its smallest id as rep; copies (id): the rows that aren't their
    own rep. No task holds more than a part of the rows of one sig.
    """
    signed = cut_lineage(signed)  # ids and 16 bytes: what they were worked out from isn't read again
    reps = signed.groupBy("sig").agg(F.min("id").alias("rep"))
    members = cut_lineage(join_facts(signed, reps, "sig").select("rep", "id"))
    n, many = members.agg(F.count(F.expr("case when rep = id then 1 end")), F.count(F.expr("case when rep != id then 1 end"))).first()
    return members, members.where("id != rep").select("id"), n, many


def similar_texts(df: DataFrame, key: str, text: str = "text", words: int = 5, threshold: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(links, members).

    links: (rep_a, rep_b) BIGINT, rep_a < rep_b, all pairs of different shingle sets whose Jaccard
    similarity is at least ``threshold``. members: (rep, id), one row per text with enough words: texts
    with the same shingle set share the smallest id among them as rep. A text's shingles are its distinct
    runs of ``words`` lower-cased words, parted by any white space.

    Null texts and texts with fewer than ``least_words`` (or ``words``) words have no row; ids must be
    unique and not null (rows with a null id are left out). Empty tables give empty results.

    Steps: (1) shingle counts by hash in a table of 2^22 to 2^24 buckets, by the number of texts, to order rare first; (2) the smallest id of
    each set, by 128-bit hash; (3) prefix tokens of representatives, self-joined on the token with length
    and positional filters; prefixes are 3 tokens longer than one common token needs, so a pair must have
    4 in common there (all it needs, where that is fewer); (4) the pairs left, once each, joined with the
    sets of the records that occur in any of them, suffix filter, exact overlap.

    A token that HOT records or more have is joined by bands of lengths: the longer record of a pair looks only into
    the bands that its length and the token's place in it leave. Of records that share but a common
    part, each has it at the end of its order, and so none of them meet.
    """
    texts = df.select(df[key].cast("long").alias("id"), df[text].alias("text")).where("id is not null and text is not null")
    sc = df.sparkSession.sparkContext
    n, t = words, threshold

    bits = count_bits(df.select(key).count())
    order = sc.broadcast(hashed_counts(texts, lambda b: shingle_hashes(strings(b, "text"), n, least_words)[2], bits, rarity, ROWS))

    def signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, sigs = [], []
        for row, s in _sets(strings(batch, "text"), order.value, n, least_words):
            rows.append(row)
            sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
        return pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(rows, pa.int64())), pa.array(sigs, pa.binary())], ["id", "sig"])

    members, copies, _, many = fold_equal(map_batches(texts, signatures, "id long, sig binary", ROWS))
    maybe = sc.broadcast(IdFilter.of(copies, many))

    # Only rows that the filter can't clear are looked up in the list of copies.
    def in_filter(wanted: bool, of):
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(of.value.may_hold(column(batch, "id").to_numpy(zero_copy_only=False)) == wanted))

        return kernel

    hot_from = np.uint64(rarity(np.array([HOT]))[0])

    def prefixes(batch: pa.RecordBatch, cleared: bool) -> pa.RecordBatch | None:
        if cleared:
            batch = in_filter(False, maybe)(batch)
        ids = column(batch, "id").to_numpy(zero_copy_only=False)
        keys, own, at = [], [], []

        def add(k: np.ndarray, i: int, place: np.ndarray, role: int, size: int) -> None:
            keys.append(k), own.append(np.full(len(k), i, np.int64)), at.append((place << 32) | (role << 30) | size)

        for row, s in _sets(strings(batch, "text"), order.value, n, least_words):
            size, p = len(s), _prefix(len(s), t)
            common = p - int(np.searchsorted(s[:p] >> np.uint64(56), hot_from))  # the rare come first
            i, rare = ids[row], p - common
            add(s[:rare], i, np.arange(rare), 0, size)
            if common:
                place = np.arange(rare, p)
                longest = np.minimum(size, np.floor((size - place + SHARED - 1 + 1e-6) * (1 + t) / t - size)).astype(np.int64)
                add(_banded(s[rare:p], _band(size)), i, place, 1, size)
                for band in range(_band(max(1, math.ceil(t * size - 1e-6))), _band(size) + 1):
                    fits = longest >= math.floor(math.exp(band * BAND))
                    add(_banded(s[rare:p][fits], band), i, place[fits], 2, size)
        if not keys:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own)), pa.array(np.concatenate(at).astype(np.int64))], ["token", "id", "at"])

    schema = "token long, id long, at long"
    unsure = map_batches(texts, in_filter(True, maybe), "id long, text string", ROWS).join(copies, "id", "left_anti")
    tokens = map_batches(texts, lambda b: prefixes(b, True), schema, ROWS).unionByName(map_batches(unsure, lambda b: prefixes(b, False), schema, ROWS))

    a, b = tokens.alias("a"), tokens.alias("b")
    la, lb = F.expr("a.at & 1073741823"), F.expr("b.at & 1073741823")
    ra, rb = F.expr("shiftright(a.at, 30) & 3"), F.expr("shiftright(b.at, 30) & 3")
    pa_, pb = F.expr("shiftright(a.at, 32)"), F.expr("shiftright(b.at, 32)")
    need = F.ceil((la + lb) * (t / (1 + t)) - 1e-6)
    shared = F.least(need, F.lit(SHARED))
    met = ((ra == 0) & (rb == 0) & (F.col("a.id") < F.col("b.id"))) | ((ra == 2) & (rb == 1) & ((la > lb) | ((la == lb) & (F.col("a.id") > F.col("b.id")))))
    near = (F.col("a.token") == F.col("b.token")) & met & (F.least(la, lb) >= F.greatest(la, lb) * t - 1e-6) & (F.least(la - pa_, lb - pb) > need - shared)
    pairs = a.join(b, near).select(F.least("a.id", "b.id").alias("rep_a"), F.greatest("a.id", "b.id").alias("rep_b"), (1 / shared).alias("part"))
    pairs = pairs.groupBy("rep_a", "rep_b").agg(F.sum("part").alias("parts")).where("parts >= 0.999999")
    pairs = cut_lineage(pairs.select("rep_a", "rep_b"))

    wanted = sc.broadcast(IdFilter.of(pairs, 2 * pairs.count()))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = in_filter(True, wanted)(batch)
        rows, out = [], []
        for row, s in _sets(strings(batch, "text"), order.value, n, least_words):
            rows.append(row)
            out.append(s.tobytes())
        return pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], ["id", "keys"])

    held = map_batches(texts, sets, "id long, keys binary", ROWS)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = column(batch, "keys_a"), column(batch, "keys_b")
        good = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            least = math.ceil((len(x) + len(y)) * t / (1 + t) - 1e-9)
            if suffix_bound(x, y) >= least:
                k = np.searchsorted(y, x)
                k[k == len(y)] = 0
                good[i] = int((y[k] == x).sum()) >= least
        return pa.RecordBatch.from_arrays([column(batch, "rep_a"), column(batch, "rep_b")], ["rep_a", "rep_b"]).filter(pa.array(good))

    both = pairs.join(held.select(F.col("id").alias("rep_a"), F.col("keys").alias("keys_a")), "rep_a")
    both = both.join(held.select(F.col("id").alias("rep_b"), F.col("keys").alias("keys_b")), "rep_b")
    return map_batches(both, verify, "rep_a long, rep_b long", ROWS), members


GRAM = 5


def similar_strings(df: DataFrame, key: str, value: str, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(links, members) of short strings with 1 - edit distance / longer length >= ``threshold``.

    links: (rep_a, rep_b) of different strings; members: (rep, id), equal strings sharing a rep. Null and
    empty strings have no row. Lengths count code points.

    With d edits allowed for a pair, the longer string is cut into disjoint 5-grams, of which an edit
    destroys one at most: one of its d + 1 rarest survives as a gram of the shorter, shifted by d at most.
    The threshold must leave more chunks than edits, which holds from 0.8.
    """
    if threshold < 0.8:
        raise ValueError("threshold must be at least 0.8")
    named = df.select(df[key].cast("long").alias("id"), df[value].alias("name")).where("id is not null and name != ''")
    reps = named.groupBy("name").agg(F.min("id").alias("rep"))
    members = cut_lineage(join_facts(named, reps, "name").select("rep", "id"))
    names = cut_lineage(reps.select(F.col("rep").alias("id"), "name"))
    sc, slack, q = df.sparkSession.sparkContext, 1 - threshold, GRAM

    def grams(name: str) -> list[int]:
        padded = name + "\0" * (q - 1)
        return [_words[padded[i : i + q]] for i in range(len(name))]

    def all_hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([h for s in strings(batch, "name") for h in set(grams(s))], dtype=np.uint64)

    order = sc.broadcast(rarity(hashed_counts(names, all_hashes, 18, rows=ROWS)))

    hot_from = int(rarity(np.array([HOT]))[0])

    def placed(gram: int, size: int, place: int) -> int:
        return (gram * 0x9E3779B97F4A7C15 + size * 0xC2B2AE3D27D4EB4F + place * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF

    def rows(batch: pa.RecordBatch, chunks: bool) -> pa.RecordBatch:
        ids = column(batch, "id").to_pylist()
        token, own, at, mark = [], [], [], []
        rare = order.value
        for i, s in zip(ids, strings(batch, "name")):
            g, n = grams(s), len(s)
            places = range(n)
            if chunks:
                edits = int(slack * n + 1e-9)
                places = sorted(range(0, n, q), key=lambda p: (rare[g[p] & (len(rare) - 1)], g[p]))[: edits + 1]
            bits = 0
            for pair in {s[k : k + 2] for k in range(n - 1)}:
                bits |= 1 << (_words[pair] & 63)
            keys = []
            for p in places:
                if rare[g[p] & (len(rare) - 1)] < hot_from:
                    keys.append((g[p], p))
                elif chunks:  # a gram of many names meets only those of a length and at a place that the edits allow
                    keys += [(placed(g[p], n - less, p + by), p) for less in range(edits + 1) for by in range(-edits, edits + 1) if abs(by) + abs(less + by) <= edits]
                else:
                    keys.append((placed(g[p], n, p), p))
            token += [k for k, _ in keys]
            at += [p << 32 | n for _, p in keys]
            own += [i] * len(keys)
            mark += [bits] * len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.array(token, np.uint64).view(np.int64)), pa.array(own, pa.int64()), pa.array(at, pa.int64()), pa.array(np.array(mark, np.uint64).view(np.int64))], ["token", "id", "at", "mark"])

    schema = "token long, id long, at long, mark long"
    x, y = map_batches(names, lambda b: rows(b, False), schema, ROWS).alias("x"), map_batches(names, lambda b: rows(b, True), schema, ROWS).alias("y")
    x_size, y_size = F.expr("x.at & 4294967295"), F.expr("y.at & 4294967295")
    shift, longer = F.expr("shiftright(x.at, 32) - shiftright(y.at, 32)"), x_size - y_size
    edits = F.floor(y_size * slack + 1e-9)
    near = (F.col("x.token") == F.col("y.token")) & ((longer < 0) | ((longer == 0) & (F.col("x.id") < F.col("y.id")))) & (F.abs(shift) + F.abs(longer - shift) <= edits)
    near = near & (F.expr("bit_count(x.mark ^ y.mark)") <= edits * 4)  # an edit changes four pairs of letters at most
    pairs = x.join(y, near).select(F.least("x.id", "y.id").alias("rep_a"), F.greatest("x.id", "y.id").alias("rep_b")).distinct()
    pairs = pairs.join(names.select(F.col("id").alias("rep_a"), F.col("name").alias("name_a")), "rep_a").join(names.select(F.col("id").alias("rep_b"), F.col("name").alias("name_b")), "rep_b")
    longest = F.greatest(F.length("name_a"), F.length("name_b"))
    allowed = F.floor(longest * slack + 1e-9)
    distance = F.levenshtein("name_a", "name_b")
    return pairs.where(distance <= allowed).select("rep_a", "rep_b"), members.select("rep", "id")


BLOCK = 4096


def unfold(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of members of linked or equal representatives. Large where copies are many: ``classes`` isn't.

    A group of over BLOCK members is taken in as many parts, each of which meets all members in a task of its own.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    grouped = cut_lineage(join_facts(members, sizes.select("rep", parts.alias("parts")), "rep"))
    left = grouped.select("rep", F.col("id").alias("x"), part.alias("part"))
    right = grouped.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    inside = left.join(right, ["rep", "part"]).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    across = links.join(members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), "rep_a").join(members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y")), "rep_b")
    return inside.unionByName(across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, copies, links): one row per record; class_id is the smallest id with the same token set, links counts other classes within the threshold."""
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    facts = sizes.join(degree, "rep", "left").select("rep", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return join_facts(members, facts, "rep").select("id", F.col("rep").alias("class_id"), "copies", "links")


def file_stem(c):
    """Without the last extension, lower-cased, letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?s)(?<=.)\.[^.]*$", "")), r"[^\p{L}\p{N}]", "")

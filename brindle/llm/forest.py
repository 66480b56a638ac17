"""Nearest neighbours by a hash-prefix forest: sorted arrays of hash strings, longest prefixes first, exact blocks under each."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.arrow import column, map_batches
from brindle.llm.neardup import fold_equal
from brindle.llm.sketches import FAN, IdFilter
from brindle.plans.physical import cut_lineage, join_facts

DIM, SEED, TREES = 384, 7, 2
FEW = 1 << 20  # ids of copies that may be sent to every task
SAMPLE, TILE, HELD, STEP = 8192, 16384, 16384, 512  # vectors in the sample (about), a tile, a packing buffer, a product


def usable(batch: pa.RecordBatch, name: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors with ``dim`` finite numbers, not all zero."""
    c = column(batch, name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    ends = c.offsets.to_numpy()
    right = np.flatnonzero((np.diff(ends) == dim) & c.is_valid().to_numpy(zero_copy_only=False))
    if not len(right):
        return right, np.zeros((0, dim), np.float32)
    flat = c.values.to_numpy(zero_copy_only=False).astype(np.float32)  # null elements become NaN
    x = flat[ends[right][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return right[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow for the largest floats, no underflow for the smallest
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(x: np.ndarray) -> bytes:
    """Float32 rows without loss, the four bytes of the numbers apart: they compress well where numbers are rounded."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, dim: int) -> np.ndarray:
    planes_ = np.frombuffer(pa.decompress(blob, decompressed_size=n * dim * 4, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes_.T).view(np.float32).reshape(n, dim)


def _sums(x: np.ndarray, home: np.ndarray, cells: int) -> np.ndarray:
    return (home == np.arange(cells)[:, None]).astype(np.float32) @ x


def hash_strings(c: np.ndarray, rng: np.random.Generator) -> list[str]:
    """A string of bits for each centre: alike ones share a long prefix. Each bit parts the centres of a prefix by two of them."""
    out = [""] * len(c)
    todo = [np.arange(len(c))]
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        x = c[at]
        two = x[rng.choice(len(at), 2, replace=False)]
        for _ in range(6):
            side = x @ two[0] < x @ two[1]
            if side.all() or not side.any():
                break
            two = np.stack([x[~side].mean(axis=0), x[side].mean(axis=0)])
        if min(side.sum(), (~side).sum()) * 10 < len(at):  # strings of a bounded length even where centres are alike
            side = np.argsort(np.argsort(x @ (two[1] - two[0]), kind="stable"), kind="stable") >= len(at) // 2
        for i, bit in zip(at.tolist(), side.tolist()):
            out[i] += "1" if bit else "0"
        todo += [at[~side], at[side]]
    return out


class Tree:
    """A sorted array of hash strings, one for each centre of a sample's k-means, and what is known of the vectors under each.

    A vector's string is that of its nearest centre. ``low`` and ``high`` give, for each string and each number
    of bits taken off its end, the stretch of the array that shares the prefix left.
    """

    SAFE, CLOSE, Z = 1.15, 0.9, 5.0

    def __init__(self, sample: np.ndarray, n: int, k: int, seed: int):
        self.k, rng = k, np.random.default_rng(seed)
        count = int(np.clip(round(np.sqrt(n) / 4), 1, 2048)) if n > 2000 else 1
        c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
        for _ in range(12 if len(c) > 1 else 0):
            sums = _sums(sample, (sample @ c.T).argmax(axis=1), len(c))
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
        strings = hash_strings(c, rng)
        order = sorted(range(len(c)), key=strings.__getitem__)
        self.centres, self.strings = np.ascontiguousarray(c[order], np.float32), [strings[i] for i in order]
        prefixes = [[s[: max(0, len(s) - up)] for s in self.strings] for up in range(max(map(len, strings)) + 1)]
        self.low = np.array([[bisect_left(self.strings, p) for p in row] for row in prefixes])
        self.high = np.array([[bisect_left(self.strings, p + "2") for p in row] for row in prefixes])
        rest = sample - c[(sample @ c.T).argmax(axis=1)]
        values = np.linalg.eigvalsh((rest.T @ rest / len(rest)).astype(np.float64))
        self.free = max(1.0, float(values.sum() ** 2 / max((values**2).sum(), 1e-30)))  # directions that the rest really varies in

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(axis=1)

    def complete(self, sizes: np.ndarray, sums: np.ndarray) -> None:
        self.sizes, self.up_to = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.means = (sums / np.maximum(sizes, 1)[:, None]).astype(np.float32)
        self.spread = self.SAFE * np.sqrt(np.maximum(1 - (self.means.astype(np.float64) ** 2).sum(axis=1), 1e-6) / self.free)
        share = np.clip(self.k / np.maximum(sizes - 1, 1), 1e-12, 1)
        self.reach = np.array([_quantile(q) for q in share])  # of the k-th of a string's vectors, in spreads
        gaps = np.maximum(2 - 2 * self.centres @ self.centres.T, 0)
        self.apart = np.sqrt(gaps) * np.sqrt(2 - 2 * self.CLOSE) * min(1.0, self.Z / np.sqrt(self.free))


class Forest:
    """Trees searched in step: longest prefix first, one bit less in all of them until enough is open.

    A vector descends to its own string in every tree. Then prefixes lose a bit at a time in all trees, until
    those left open hold ENOUGH * k vectors and, in one tree at least, under LOST of the k are expected
    outside. What is expected of a string is that the cosines to its vectors spread normally about that to
    their mean; the bound to beat is the k-th best expected of the strings already open. In the tree that
    asks least, the vector is compared with all vectors of the open strings (but those expected to add nothing),
    in the others with those of its own string. A string is asked too where a vector at cosine CLOSE may have it as its own.
    """

    LOST, ENOUGH = 0.01, 3

    def __init__(self, trees: list[Tree], k: int, least: float | None):
        self.trees, self.k, self.least = trees, k, -1.0 if least is None else least

    def asks(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(home string, a row of flags for each vector, true at the strings it is compared with), by tree."""
        rows, k = np.arange(len(x)), self.k
        bound, seen = np.full(len(x), self.least), []
        for t in self.trees:
            about, near = x @ t.means.T, x @ t.centres.T
            home = near.argmax(axis=1)
            kth = about[rows, home] + t.spread[home] * t.reach[home] / t.SAFE
            bound = np.maximum(bound, np.where(t.sizes[home] > k, kth, -1.0))
            seen.append((about, near, home))
        steps = max(len(t.low) for t in self.trees)
        least_out, held = np.full((len(x), steps), np.inf), np.zeros((len(x), steps))
        expects, outs = [], []
        for t, (about, _, home) in zip(self.trees, seen):
            expected = t.sizes * _tail((bound[:, None] - about) / t.spread)
            expected[bound <= -1.0] = t.sizes
            up = np.minimum(np.arange(steps), len(t.low) - 1)
            low, high = t.low[up][:, home].T, t.high[up][:, home].T
            total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(expected, axis=1)], axis=1)
            out = np.maximum(total[:, -1:] - (np.take_along_axis(total, high, 1) - np.take_along_axis(total, low, 1)), 0.0)
            out[:, up == len(t.low) - 1] = 0.0
            least_out, held = np.minimum(least_out, out), held + t.up_to[high] - t.up_to[low]
            expects.append(expected), outs.append((out, low, high))
        enough = (least_out <= self.LOST * k) & (held >= self.ENOUGH * k)
        enough[:, -1] = True
        step = enough.argmax(axis=1)
        flags, price = [], np.zeros((len(self.trees), len(x)))
        for i, (t, expected, (out, low, high), (_, near, home)) in enumerate(zip(self.trees, expects, outs, seen)):
            place = np.arange(len(t.sizes))
            open_ = (place >= low[rows, step][:, None]) & (place < high[rows, step][:, None])
            inside = np.where(open_, expected, 0.0)
            order = np.argsort(inside, axis=1)
            f = np.zeros(inside.shape, bool)
            np.put_along_axis(f, order, np.cumsum(np.take_along_axis(inside, order, 1), axis=1) > np.maximum(self.LOST * k - out[rows, step], 0.0)[:, None], 1)
            f |= near[rows, home][:, None] - near <= t.apart[home]
            f &= t.sizes > 0
            f[rows, home] = True
            flags.append(f)
            price[i] = np.where(out[rows, step] <= self.LOST * k, f @ t.sizes.astype(np.float64), np.inf)
        chosen = price.argmin(axis=0)
        for i, (f, (_, _, home)) in enumerate(zip(flags, seen)):
            f[chosen != i] = False
            f[rows, home] = True
        return [(home, f) for f, (_, _, home) in zip(flags, seen)]


def _tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z, within 1e-7 (Abramowitz and Stegun 26.2.17)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    q = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, q, 1 - q)


def _quantile(share: float) -> float:
    return NormalDist().inv_cdf(1 - share) if share < 1 else -40.0


def close_pairs(df: DataFrame, key: str, vector: str, least: float | None = None, dim: int = DIM, k: int = 10, seed: int = SEED, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (rep, other, cosine) to the k most similar different vectors, with cosine >= ``least`` if given; members (rep, id).

    A hash-prefix forest: ``trees`` sorted arrays of hash strings learned on a sample, descended to the longest
    prefix and ascended in step (``Forest``). What is open to a vector is compared exactly, in blocks; no window
    or count caps it, so a group of any size and density is searched whole. A string with over TILE vectors or
    askers is parted into that many more tiles, each asker meeting all of them. Cosines are verified in double
    precision. A link may be listed once for each tree.

    Null, incomplete, non-finite and all-zero vectors are left out; length plays no part. Vectors equal in
    all numbers count as one record with several ``members``. Ties are ordered by id.
    """
    vectors = df.select(df[key].cast("long").alias("id"), df[vector].alias("v")).where("id is not null and v is not null")
    spark = df.sparkSession
    sc = spark.sparkContext

    def signature(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, x = usable(batch, "v", dim)
        sigs = [xxhash.xxh3_128_digest(r.tobytes()) for r in x + np.float32(0)]  # -0.0 becomes 0.0
        return pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(rows)), pa.array(sigs, pa.binary())], ["id", "sig"])

    members, copies, n, many = fold_equal(map_batches(vectors, signature, "id long, sig binary"))
    maybe = sc.broadcast(IdFilter.of(copies, many)) if many > FEW else None

    def passing(of, wanted: bool):
        return lambda b: b.filter(pa.array(of.value.may_hold(column(b, "id").to_numpy(zero_copy_only=False)) == wanted))

    if many <= FEW:  # then the ids themselves may be sent, and one reading of the table does
        listed = sc.broadcast(np.sort(np.array([r.id for r in copies.toLocalIterator()], np.int64)))
        reps = map_batches(vectors, lambda b: b.filter(pa.array(~np.isin(column(b, "id").to_numpy(zero_copy_only=False), listed.value, assume_unique=False))), "id long, v array<float>")
    else:
        sure = map_batches(vectors, passing(maybe, False), "id long, v array<float>")
        reps = sure.unionByName(map_batches(vectors, passing(maybe, True), "id long, v array<float>").join(copies, "id", "left_anti"))
    links_of = "rep long, other long, cosine double"
    if n < 2:
        return spark.createDataFrame([], links_of), members

    every = max(1, n // SAMPLE)

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = column(batch, "id").to_numpy(zero_copy_only=False)
        b = batch.filter(pa.array((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(every) == 0))
        _, x = usable(b, "v", dim)
        return pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([_pack(x)], pa.binary())], ["n", "blob"]) if len(x) else None

    got = map_batches(reps, sampled, "n long, blob binary").collect() or map_batches(reps.limit(SAMPLE), sampled, "n long, blob binary").collect()
    sample = np.concatenate([_unpack(r.blob, r.n, dim) for r in got]) if got else np.ones((1, dim), np.float32)
    unit = _unit(sample[: 2 * SAMPLE]).astype(np.float32)
    forest = Forest([Tree(unit, n, k, seed + i) for i in range(trees)], k, least)
    first = sc.broadcast(forest)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(np.zeros(len(t.centres), np.int64), np.zeros(t.centres.shape)) for t in first.value.trees]
        for batch in batches:
            _, x = usable(batch, "v", dim)
            if len(x):
                x = _unit(x).astype(np.float32)
                for t, (sizes, sums) in zip(first.value.trees, own):
                    home = t.home(x)
                    sums += _sums(x, home, len(sums))
                    sizes += np.bincount(home, minlength=len(sizes))
        task = TaskContext.get().partitionId()
        for i, (sizes, sums) in enumerate(own):
            at = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int32()), pa.array(at), pa.array([task] * len(at), pa.int32()), pa.array(sizes[at]), pa.array([r.tobytes() for r in sums[at]], pa.binary())], ["tree", "cell", "task", "n", "total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x = own.setdefault((r["tree"], r["cell"], r["task"]), [0, 0.0])
                x[0] += r["n"]
                x[1] = x[1] + np.frombuffer(r["total"])
        for (tree, cell, task), (m, total) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([cell]), pa.array([task], pa.int32()), pa.array([m]), pa.array([total.tobytes()], pa.binary())], ["tree", "cell", "task", "n", "total"])

    sums_of = "tree int, cell long, task int, n long, total binary"
    parts_, left = reps.mapInArrow(totals, sums_of), reps.rdd.getNumPartitions()
    while left > 1:  # added up FAN tasks at a time, in tasks that grow with the input
        left = -(-left // FAN)
        parts_ = parts_.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).repartition(8 * left, "tree", "cell", "task").mapInArrow(added, sums_of)
    sizes, sums = [np.zeros(len(t.centres), np.int64) for t in forest.trees], [np.zeros(t.centres.shape) for t in forest.trees]
    for r in parts_.toLocalIterator():
        sizes[r.tree][r.cell] += r.n
        sums[r.tree][r.cell] += np.frombuffer(r.total)
    for t, a, b in zip(forest.trees, sizes, sums):
        t.complete(a, b)
    ready = sc.broadcast(forest)

    askers = [np.zeros(len(a)) for a in sizes]  # about, from the sample: they only say how many tasks share a string's askers
    for i in range(0, len(unit), STEP):
        for own, (_, flags) in zip(askers, forest.asks(unit[i : i + STEP])):
            own += flags.sum(axis=0) * (n / len(unit))
    cuts = [(-(-a // TILE), np.ceil(np.maximum(b, 1) / TILE).astype(np.int64)) for a, b in zip(sizes, askers)]
    parts = sc.broadcast(cuts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            i, x = np.concatenate(ids), np.concatenate(raw)
            salt = (i.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            found = [ready.value.asks(_unit(x[a : a + STEP]).astype(np.float32)) for a in range(0, len(i), STEP)]
            for tree, (blocks, turns) in enumerate(parts.value):
                homes, wants = np.concatenate([f[tree][0] for f in found]), np.concatenate([f[tree][1] for f in found])
                for c in np.flatnonzero(wants.any(axis=0)):
                    own, ask = np.flatnonzero(homes == c), np.flatnonzero(wants[:, c])
                    rows = [(b, t, 0, own[salt[own] % blocks[c] == b]) for b in range(blocks[c]) for t in range(turns[c])]
                    rows += [(b, t, 1, ask[salt[ask] % turns[c] == t]) for b in range(blocks[c]) for t in range(turns[c])]
                    if blocks[c] == turns[c] == 1:  # members are sent once and ask where they stand
                        rows[1] = (0, 0, 1, ask[homes[ask] != c])
                    for b, t, role, at in rows:
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([f"{tree}/{ready.value.trees[tree].strings[c]}/{b}/{t}"]), pa.array([role], pa.int32()), pa.array([i[at].tolist()], pa.list_(pa.int64())), pa.array([_pack(x[at])], pa.binary())], ["tile", "role", "ids", "blob"])

        for batch in batches:
            rows, x = usable(batch, "v", dim)
            ids.append(column(batch, "id").to_numpy(zero_copy_only=False)[rows]), raw.append(x)
            held += len(x)
            if held >= HELD:
                yield from flush()
                ids, raw, held = [], [], 0
        if held:
            yield from flush()

    tiles = reps.mapInArrow(packed, "tile string, role int, ids array<long>, blob binary")
    tiles = tiles.repartition(max(2 * sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "tile").sortWithinPartitions("tile", "role")
    alone = {f"{i}/{t.strings[c]}/0/0" for i, (t, (a, b)) in enumerate(zip(forest.trees, cuts)) for c in np.flatnonzero((a == 1) & (b == 1))}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, raw, unit = None, [], [], []

        def joined() -> None:
            if len(ids) > 1:
                ids[:], raw[:], unit[:] = [np.concatenate(ids)], [np.concatenate(raw)], [np.concatenate(unit)]

        def ask(i: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            joined()
            if ids:
                for a in range(0, len(i), STEP):
                    yield _best(i[a : a + STEP], x[a : a + STEP], ids[0], raw[0], unit[0], k, least)

        def itself() -> Iterator[pa.RecordBatch]:
            if tile in alone and ids:
                joined()
                yield from ask(ids[0], raw[0])

        for batch in batches:
            for r in batch.to_pylist():
                if r["tile"] != tile:
                    yield from itself()
                    tile, ids, raw, unit = r["tile"], [], [], []
                i = np.array(r["ids"], np.int64)
                x = _unpack(r["blob"], len(i), dim)
                if r["role"]:
                    yield from ask(i, x)
                else:
                    ids.append(i), raw.append(x), unit.append(_unit(x).astype(np.float32))
        yield from itself()

    return tiles.mapInArrow(compare, links_of), members


def _best(i: np.ndarray, x: np.ndarray, ids: np.ndarray, raw: np.ndarray, unit: np.ndarray, k: int, least: float | None) -> pa.RecordBatch:
    """The k best of ``ids`` for each row of ``x``, equal cosines by id; single precision only chooses what is verified."""
    s = _unit(x).astype(np.float32) @ unit.T
    _, own, at = np.intersect1d(i, ids, assume_unique=True, return_indices=True)
    s[own, at] = -2
    slack = np.float32(1e-5)
    bound = np.full(len(s), -1.5, np.float32) if least is None else np.full(len(s), least, np.float32) - slack
    if len(ids) > k:
        many = np.flatnonzero((s >= bound[:, None]).sum(axis=1) > k)
        if len(many):
            best = s if len(many) == len(s) else s[many]
            wide = min(16, len(ids) // (2 * k))
            if wide > 1:  # the k-th of the groups' best is no better than the k-th of all
                best = best[:, : len(ids) // wide * wide].reshape(len(many), -1, wide).max(axis=2)
            bound[many] = np.maximum(bound[many], np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] - slack)
    q, b = np.nonzero(s >= bound[:, None])
    cosine = np.concatenate([np.zeros(0), *[(_unit(x[q[a : a + STEP]]) * _unit(raw[b[a : a + STEP]])).sum(axis=1) for a in range(0, len(q), STEP)]])
    order = np.lexsort((ids[b], -cosine, q))
    q, b, cosine = q[order], b[order], cosine[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = (place < k) & (cosine >= (-2 if least is None else least - 1e-9))
    return pa.RecordBatch.from_arrays([pa.array(i[q[keep]]), pa.array(ids[b[keep]]), pa.array(cosine[keep])], ["rep", "other", "cosine"])


def nearest_lists(links: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """(id, near ARRAY<STRUCT<neighbour, cosine>>): each vector's k most similar others among the links, best first, ties by id.

    Of the members of one record only the k + 1 with the lowest ids can be among anyone's k, so a large
    group of copies is not unfolded into all its pairs. Links are shuffled once, by record; copies join
    where they lie if they are few.
    """
    extra = members.where("rep != id")
    some = extra.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k)
    some = cut_lineage(some.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("copies")))  # k at most each
    few = some.count() <= FEW // 16
    sent = F.broadcast if few else lambda df: df
    # a record that has copies is its own neighbour, so to say
    own = some.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    once = links.unionByName(own).withColumn("same", F.lag("other").over(best)).where("same is null or same != other").drop("same")  # trees may repeat a link
    ranked = once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    near = ranked.join(sent(some.select(F.col("rep").alias("other"), "copies")), "other", "left")
    ids = F.concat(F.array("other"), F.coalesce("copies", F.array().cast("array<bigint>")))
    near = near.select("rep", "cosine", F.explode(ids).alias("neighbour"))
    pair = F.struct((-F.col("cosine")).alias("far"), "neighbour", "cosine")
    listed = near.groupBy("rep").agg(F.sort_array(F.collect_list(pair)).alias("near"))  # (k + 1) squared at most
    listed = listed.select("rep", F.transform("near", lambda x: F.struct(x.neighbour, x.cosine)).alias("near"))
    if few and extra.count() <= FEW // 4:  # all of them may be sent, so a group of them may be a list
        copies = F.broadcast(extra.groupBy("rep").agg(F.collect_list("id").alias("ids")))
        each = listed.join(copies, "rep", "left").select("near", F.explode(F.concat(F.array("rep"), F.coalesce("ids", F.array().cast("array<bigint>")))).alias("id"))
    else:
        each = join_facts(members, listed, "rep")
    return each.select("id", F.slice(F.filter("near", lambda x: x.neighbour != F.col("id")), 1, k).alias("near")).where(F.size("near") > 0)


def nearest(links: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """(id, neighbour, cosine, rank) of ``nearest_lists``."""
    rows = nearest_lists(links, members, k).select("id", F.posexplode("near").alias("place", "x"))
    return rows.select("id", "x.neighbour", "x.cosine", (F.col("place") + 1).alias("rank"))

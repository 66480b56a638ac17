"""Text statistics per document, their distribution per language, and the form a text has as a whole."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrow import column, map_batches, strings
from brindle.llm.neardup import _words
from brindle.llm.sketches import hashed_counts
from brindle.plans.physical import cut_lineage

STATS = ("n_words", "mean_word_length", "symbol_ratio", "end_punct_share", "common_share", "mean_line_words", "known_share", "cell_share", "item_share")
COUNT_BITS = 22
COMMON_SHARE, KNOWN_SHARE, LEAST_DOCS = 0.02, 0.0005, 3  # of the documents of a language, of a script; in documents
LEAST_GROUP = 30  # documents that a language or a script must have to be judged by its own distribution
FAR, EMPTY = 3.5, 1e-4  # robust z-score of a tail; share of a group's texts that a gap between two kinds may hold
BINS = 512
TERMINAL = set(".!?。！？।؟…")
ENDING = TERMINAL | set("\"'”’»)]」』:;,")
UNSPACED = {"han", "kana", "thai", "lao", "khmer", "myanmar", "tibetan", "bopomofo", "yi"}

_L, _M, _N, _S, _W = 1, 2, 3, 4, 0
_table: np.ndarray | None = None
_scripts: tuple[np.ndarray, list[str]] | None = None


def _char_table() -> np.ndarray:
    global _table
    if _table is None:
        t = np.full(0x110000, _S, dtype=np.uint8)
        for i in range(0x10000):
            c = unicodedata.category(chr(i))
            t[i] = _W if chr(i).isspace() else {"L": _L, "M": _M, "N": _N}.get(c[0], _S)
        t[0xE000:0xF900] = _S
        t[0x20000:0x33480] = _L
        _table = t
    return _table


def _script_table() -> tuple[np.ndarray, list[str]]:
    """(number of each character's script, names): the first word of a letter's Unicode name."""
    global _scripts
    if _scripts is None:
        names, numbers = ["none"], {}
        t = np.zeros(0x110000, dtype=np.uint8)
        for i in np.flatnonzero(_char_table()[:0x10000] == _L).tolist():
            word = unicodedata.name(chr(i), "none").split()[0].split("-")[0].lower()
            word = {"cjk": "han", "hiragana": "kana", "katakana": "kana", "halfwidth": "kana", "fullwidth": "latin", "modifier": "none"}.get(word, word)
            if word not in numbers and len(names) < 255:
                numbers[word] = len(names)
                names.append(word)
            t[i] = 0 if word == "none" else numbers.get(word, 0)
        t[0x20000:0x33480] = numbers["han"]
        _scripts = t, names
    return _scripts


def script_of(codes: np.ndarray, kinds: np.ndarray) -> str:
    """The script that at least half of the letters are of (``kana`` for Japanese); ``mixed``, or ``none`` without letters."""
    letters = codes[kinds == _L]
    if not len(letters):
        return "none"
    table, names = _script_table()
    counts = np.bincount(table[letters], minlength=len(names))
    counts[0] = 0
    han, kana = counts[names.index("han")], counts[names.index("kana")]
    if kana * 10 > len(letters) and kana + han > len(letters) // 2:
        return "kana"
    best = int(counts.argmax())
    return names[best] if counts[best] * 2 >= len(letters) else "mixed"


def language_of(lang: str | None) -> str:
    return (lang or "").strip().lower()[:16]


def units_of(text: str, script: str) -> list[str]:
    """What is looked up: words without the marks around them, or pairs of characters where no spaces part the words."""
    if script in UNSPACED:
        runs = re.findall(r"[^\W\d_]+", re.sub(r"[ัิ-ฺ็-๎]", "", text))
        return [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
    return [w for x in text.lower().split() if (w := x.strip(".,;:!?\"'“”„«»()[]{}—–-‚‘’।؟،؛¿¡…/|•▪◦*#<>"))]


MARKER = re.compile(r"^\s*(?:[•▪◦●○■‣·*+–—-]|\[[ xX✓]?\]|\(?[0-9०-९๐-๙٠-٩]{1,4}[.)、]|\(?[A-Za-z]{1,3}[.)]|\(?[ivxlc]{1,6}[.)]|#+)\s+", re.I)
_COLUMNS = re.compile(r"\S(?: {2,}|\t+ *)(?=\S)")


def cells_of(line: str) -> int:
    """How many cells a line has as a row of a table; 1 where it is none."""
    s = line.strip()
    if s.count("|") >= 2 or (s.count("|") == 1 and len(s) < 60):
        return len([c for c in s.strip("|").split("|")])
    if "\t" in s:
        return s.count("\t") + 1
    gaps = len(_COLUMNS.findall(s))
    if gaps >= 1:
        return gaps + 1
    for d in (";", ","):
        if s.count(d) >= 2 and not re.search(re.escape(d) + r" \w", s):
            return s.count(d) + 1
    return 1


def describe(text: str) -> tuple:
    """(script, units, n_words, mean_word_length, symbol_ratio, end_punct_share, mean_line_words, cell_share, item_share) of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _char_table()[codes]
    script = script_of(codes, kinds)
    words = text.split()
    n_words = len(words)
    solid = int((kinds != _W).sum())
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(lines))
    ending = sum(x.rstrip()[-1] in ENDING for x in lines)
    mean_length = solid / n_words if n_words else 0.0
    symbol = float((kinds == _S).sum()) / solid if solid else 0.0
    return script, units_of(text, script), n_words, mean_length, symbol, ending / n, n_words / n, *line_shares(lines, script)


def line_shares(lines: list[str], script: str) -> tuple[float, float]:
    """(cell_share, item_share): how far the lines are rows of cells, and how far they are short items; from 0 to 1 = nearly all.

    Rows: the smaller of their shares of the lines and of the characters. Items: the least of the shares, against
    what nearly all means, of short lines and their characters, of lines without a sentence in or at the end of
    them, and of lines that have a marker or are short enough not to be wrapped prose. Two lines are neither.
    """
    n = len(lines)
    if n < 3:
        return 0.0, 0.0
    tabular = cell_chars = 0
    for x in lines:
        k = cells_of(x)
        if k >= 2:
            solid = re.sub(r"[\s|;,\t]", "", x)
            if len(x) / k < 40 and (not solid or sum(c.isalnum() for c in solid) * 2 >= len(solid) or not re.search(r"[^\w\s|;,.:+/-]", solid)):
                tabular += 1
                cell_chars += len(x)
    marked = [MARKER.match(x) for x in lines]
    bodies = [x[m.end() :].strip() if m else x.strip() for x, m in zip(lines, marked)]
    tight = script in ("han", "kana")
    limit = 40 if tight else 72
    stops = sum(bool(re.search(r"[.!?。！？।؟](?:[\"”»」』]|\s*$|\s+\S)", b)) for b in bodies)
    sizes = [len(b) for b in bodies]
    short = sum(z <= limit for z in sizes)
    short_chars = sum(z for z in sizes if z <= limit)
    listed = sum(m is not None for m in marked)
    # items end where they end; wrapped lines fill the width and have the words of sentences
    middle = max(1, sorted(sizes)[n // 2])
    per_line = sum(len(b.split()) for b in bodies) / n
    ragged = 32 / middle if script in UNSPACED else min(7.5 / max(per_line, 1e-9), 52 / middle)
    items = min(short / n / 0.9, short_chars / max(1, sum(sizes)) / 0.8, (1 - stops / n) / 0.85, max(listed / n / 0.5, ragged))
    return min(tabular / n / 0.8, cell_chars / max(1, sum(map(len, lines))) / 0.75, 1.0), min(items, 1.0)


def _keyed(hashes: np.ndarray, group: str) -> np.ndarray:
    """Places of units (their hashes) within a group in the table of counts."""
    x = (hashes ^ np.uint64(_words["\0" + group])) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - COUNT_BITS)


_TOTAL = np.array([0], np.uint64)  # the unit that every document of a group has


def text_statistics(df: DataFrame, key: str, text: str = "text", lang: str | None = "lang", dictionary: DataFrame | None = None, dictionary_text: str = "text", dictionary_lang: str = "lang", counts=None) -> DataFrame:
    """(key, lang_group, n_chars, STATS..., <stat>_z and <stat>_pct for each, form), one row per input row.

    ``unit_counts`` of ``dictionary`` (default: ``df``), or of ``counts`` if given, say in how many documents of
    a script and of a stated language a word occurs. lang_group is the text's script, with the stated language
    where LEAST_GROUP documents of that script state it and most that do are of that script. common_share is the share of words that 2 % of the
    group's documents have, known_share that of words that 0.05 % of the script's have (3 at least). Each
    statistic's distribution within its group is kept in a mergeable sketch of 512 bins, added up over all
    rows; from it come the percentile and the robust z-score (distance to the median in units of 1.4826 MAD).

    form: ``table``, ``list`` and ``junk`` are texts in a tail of the group's cell_share, item_share (upper)
    and known_share (lower): over 3.5 robust deviations from the median and beyond the widest gap in that
    tail, which parts one kind of text from the other (``cut_of``), an upper tail also beyond that of all texts; else ``prose``. Groups of under LEAST_GROUP texts
    are held against all texts. A language or script that too few documents have, so that nobody can know its words, is
    held against all texts' symbol_ratio instead; so are texts without letters. Null for null, blank and trimmed
    texts under 50 characters, whose statistics are 0 where undefined. Repeated rows get the same values.
    """
    own = df.select(df[key].alias("_key"), df[text].alias("_text"), (df[lang] if lang else F.lit(None)).cast("string").alias("_lang"))
    if counts is None:
        counts = unit_counts(df if dictionary is None else dictionary, text if dictionary is None else dictionary_text, lang if dictionary is None else dictionary_lang)
    kind = df.schema[key].dataType.simpleString()
    names = ["_key", "lang_group", "n_chars", *STATS, "rare", "trimmed"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names[1:]]
        at = lambda hashes, group: counts.value[_keyed(hashes, group).astype(np.int64)]
        for t, lg in zip(strings(batch, "_text"), strings(batch, "_lang")):
            body = (t or "").strip()
            if not body:
                values = ["none", len(t or ""), *[0.0] * len(STATS), True, 0]
            else:
                script, units, n_words, mean, symbol, ending, per_line, cells, items = describe(body)
                stated = language_of(lg)
                group, all_of = f"{script}:{stated}", int(at(_TOTAL, script)[0])
                total = int(at(_TOTAL, group)[0]) if stated else 0
                # a language is written in the script that most of its documents have
                right = total * 2 >= int(at(_TOTAL, ":" + stated)[0]) if stated else False
                rare = all_of < LEAST_GROUP or script in ("none", "mixed") or right and 0 < total < LEAST_GROUP
                if total < LEAST_GROUP or not right:
                    group, total = script, all_of
                h = np.fromiter(map(_words.__getitem__, units), np.uint64, len(units))
                common = float((at(h, group) >= max(LEAST_DOCS, COMMON_SHARE * total)).mean()) if len(h) else 0.0
                known = float((at(h, script) >= max(LEAST_DOCS, KNOWN_SHARE * all_of)).mean()) if len(h) else 0.0
                values = [group, len(t), float(n_words), mean, symbol, ending, common, per_line, known, cells, items, rare, len(body)]
            for c, v in zip(cols, values):
                c.append(v)
        arrays = [pa.array(cols[0]), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:-2]], pa.array(cols[-2], pa.bool_()), pa.array(cols[-1], pa.int32())]
        return pa.RecordBatch.from_arrays([column(batch, "_key"), *arrays], names)

    schema = f"_key {kind}, lang_group string, n_chars long, " + ", ".join(f"{s} double" for s in STATS) + ", rare boolean, trimmed int"
    stats = cut_lineage(map_batches(own, kernel, schema))  # narrow numbers only; the texts aren't kept
    sketches = df.sparkSession.sparkContext.broadcast(stat_sketches(stats.where("trimmed >= 50")))
    scored = map_batches(stats, _scorer(sketches, names), schema + "".join(f", {s}_z double, {s}_pct double" for s in STATS) + ", form string")
    return scored.select(F.col("_key").alias(key), "lang_group", "n_chars", *STATS, *[f"{s}_{x}" for s in STATS for x in ("z", "pct")], "form")


def unit_counts(df: DataFrame, text: str = "text", lang: str | None = "lang"):
    """Broadcast 2^22 hashed counts of documents: of each unit within each script and each (script, language), and of all documents of those."""
    stated = df[lang] if lang and lang in df.columns else F.lit(None)
    words_of = df.select(df[text].alias("_text"), stated.cast("string").alias("_lang"))

    def distinct_units(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for t, lg in zip(strings(batch, "_text"), strings(batch, "_lang")):
            if t and t.strip():
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                script, own = script_of(codes, _char_table()[codes]), language_of(lg)
                units = set(units_of(t, script))
                h = np.fromiter(map(_words.__getitem__, units), np.uint64, len(units))
                for g in (script, f"{script}:{own}") if own else (script,):
                    out.append(np.unique(_keyed(h, g)))
                    out.append(_keyed(_TOTAL, g))
                if own:
                    out.append(_keyed(_TOTAL, ":" + own))
        return np.concatenate(out)

    return df.sparkSession.sparkContext.broadcast(hashed_counts(words_of, distinct_units, COUNT_BITS))


def _bin(c):
    """Signed logarithmic bins, 1/16 of an octave wide and exact near 0: the same for every row, so counts merge by adding."""
    return F.least(F.lit(BINS - 1), F.floor(F.log2(c * 1000 + 1) * 16)).cast("int")


def _middle(b: np.ndarray) -> np.ndarray:
    return (2 ** ((b + 0.5) / 16) - 1) / 1000


ALL = "all"


def cut_of(n: np.ndarray, upper: bool) -> float:
    """Where the tail of a sketch begins: the middle of the widest gap beyond FAR robust deviations from the median.

    A gap is a run of bins that, with their neighbours, hold under EMPTY of the texts; it may reach up to the end
    of the scale from 0 to 1, so where a tail holds no other kind of text, hardly anything is beyond its cut. An
    upper tail starts at one half at least: what less of a text shows isn't its form.
    """
    centre, cum = _middle(np.arange(BINS)), np.cumsum(n) / n.sum()
    median, mad = _centre(n)
    low, high = (min(1.0, max(0.5, median + FAR * mad)), 1.0) if upper else (0.0, max(0.0, median - FAR * mad))
    near = np.convolve(n, np.ones(3), "same") <= EMPTY * n.sum()
    inside = (centre >= low - 1e-9) & (centre <= high)
    best, start, cut = -1.0, None, high if upper else low
    for b in np.flatnonzero(inside).tolist() + [BINS]:
        if b < BINS and near[b]:
            start = centre[b] if start is None else start
            if centre[b] - start > best:
                best, cut = centre[b] - start, (centre[b] + start) / 2
        else:
            start = None
    if best < 0 and inside.any():  # no gap: the emptiest place
        at = np.flatnonzero(inside)
        cut = centre[at[np.argmin(np.convolve(n, np.ones(3), "same")[at] / np.gradient(centre)[at])]]
    return float(cut)


def _centre(n: np.ndarray) -> tuple[float, float]:
    centre, cum = _middle(np.arange(BINS)), np.cumsum(n) / n.sum()
    median = centre[int(np.searchsorted(cum, 0.5))]
    off = np.abs(centre - median)
    order = np.argsort(off)
    mad = off[order][int(np.searchsorted(np.cumsum(n[order]) / n.sum(), 0.5))]
    return float(median), float(max(1.4826 * mad, 0.02 * abs(median), 1e-3))


def stat_sketches(stats: DataFrame) -> dict:
    """(group, stat) -> (bins' upper cumulative shares, median, 1.4826 MAD, size, lower cut, upper cut); group ALL is all of them.

    Groups of under LEAST_GROUP texts are left to ALL, so the groups are as many as languages have that many documents.
    """
    long = stats.select("lang_group", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), _bin(F.col(s)).alias("bin")) for s in STATS])).alias("x"))
    rows = long.groupBy("lang_group", "x.stat", "x.bin").agg(F.count("*").alias("n"))
    kept = rows.groupBy("lang_group").agg((F.sum("n") / len(STATS)).alias("m")).where(F.col("m") >= LEAST_GROUP).select("lang_group")
    pooled = rows.groupBy("stat", "bin").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang_group"), "stat", "bin", "n")
    grouped: dict = {}
    for r in rows.join(kept, "lang_group", "left_semi").unionByName(pooled).collect():
        grouped.setdefault((r.lang_group, r.stat), np.zeros(BINS))[r.bin] += r.n
    return {k: (np.cumsum(n) / n.sum(), *_centre(n), n.sum(), cut_of(n, False), cut_of(n, True)) for k, n in grouped.items()}


def _scorer(sketches, names: list[str]):
    """Adds <stat>_z and <stat>_pct, from the sketches of the texts' groups, and the form."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = sketches.value
        groups = [g if (g, STATS[0]) in of else ALL for g in strings(batch, "lang_group")]
        at = np.array(groups)
        arrays, added, tails = [*batch.columns], [], {}
        for s in STATS:
            x = column(batch, s).to_numpy(zero_copy_only=False)
            z, pct, below, above = np.full(len(x), np.nan), np.full(len(x), np.nan), np.zeros(len(x), bool), np.zeros(len(x), bool)
            bins = np.minimum(BINS - 1, np.floor(np.log2(x * 1000 + 1) * 16)).astype(np.int64)
            for g in np.unique(at):
                if (g, s) in of:
                    cum, median, mad, _, low, high = of[g, s]
                    own = at == g
                    z[own], pct[own] = (x[own] - median) / mad, cum[bins[own]]
                    # how lines are laid out hardly depends on the language: an upper tail is one of all texts too
                    below[own], above[own] = (z[own] < -FAR) & (x[own] < low), (z[own] > FAR) & (x[own] > max(high, of[ALL, s][5]))
            tails[s] = below, above
            arrays += [pa.array(z, from_pandas=True), pa.array(pct, from_pandas=True)]
            added += [f"{s}_z", f"{s}_pct"]
        symbol, rare = column(batch, "symbol_ratio").to_numpy(zero_copy_only=False), column(batch, "rare").to_numpy(zero_copy_only=False)
        if (ALL, "symbol_ratio") in of:
            _, median, mad, _, _, high = of[ALL, "symbol_ratio"]
            marks = ((symbol - median) / mad > FAR) & (symbol > high)
        else:
            marks = np.zeros(len(symbol), bool)
        junk = np.where(rare, marks, tails["known_share"][0])
        form = np.where(tails["cell_share"][1], "table", np.where(junk, "junk", np.where(tails["item_share"][1], "list", "prose")))
        judged = column(batch, "trimmed").to_numpy(zero_copy_only=False) >= 50
        return pa.RecordBatch.from_arrays([*arrays, pa.array([f if j else None for f, j in zip(form.tolist(), judged.tolist())], pa.string())], [*names, *added, "form"])

    return kernel
